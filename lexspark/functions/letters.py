"""Case folding and plain letters for every script, inside the JVM.

Tables come from Python's Unicode data by rule, when the module is loaded. A character that becomes one character or none
is a translation; one that becomes several is translated once for each place of its result, in texts that hold such
a character only.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the Unicode standard: Hangul syllables are numbered by lead, vowel and tail.
_HANGUL, _LEADS, _VOWELS, _TAILS = 0xAC00, 19, 21, 28
_HANGUL_LAST = _HANGUL + _LEADS * _VOWELS * _TAILS - 1


def plain(s: str) -> str:
    """Compatibility decomposition without combining marks."""
    return "".join(ch for ch in unicodedata.normalize("NFKD", s) if not unicodedata.combining(ch))


def _characters() -> Iterable[str]:
    return (chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c <= 0xDFFF and not _HANGUL <= c <= _HANGUL_LAST)


def _class(characters: Iterable[str]) -> str:
    """Ranges of a regular expression's character class."""
    out: list[list[int]] = []
    for c in sorted(map(ord, characters)):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in out)


class Replacement:
    """What characters become; the others stay."""

    def __init__(self, table: dict[str, str], hangul: bool = False):
        one = [c for c, v in table.items() if len(v) == 1] + [c for c, v in table.items() if not v]
        self._one = "".join(one), "".join(table[c] for c in one)
        # Characters with the longest results first: what has no character at a place is left out there.
        many = sorted((c for c, v in table.items() if len(v) > 1), key=lambda c: (-len(table[c]), c))
        self._many = "".join(many)
        self._places = ["".join(table[c][k] for c in many if len(table[c]) > k) for k in range(len(table[many[0]]))]
        self._hangul = hangul
        syllables = f"\\x{{{_HANGUL:X}}}-\\x{{{_HANGUL_LAST:X}}}" if hangul else ""
        # Text in Latin letters without marks is told by the first range alone.
        self._longer = f"[\\x{{80}}-\\x{{10FFFF}}&&[{_class(many)}{syllables}]]"
        self._any = f"[\\x{{80}}-\\x{{10FFFF}}&&[{_class(table)}{syllables}]]"

    def _expanded(self, x: Column) -> Column:
        out = F.when(x.rlike(self._longer), F.concat(*[F.translate(x, self._many, p) for p in self._places])).otherwise(x)
        if not self._hangul:
            return out
        n = F.ascii(x) - _HANGUL
        jamo = lambda first, count, at: F.substring(F.lit("".join(chr(first + k) for k in range(count))), at + 1, F.lit(1))
        lead, vowel = jamo(0x1100, _LEADS, F.floor(n / (_VOWELS * _TAILS)).cast("int")), jamo(0x1161, _VOWELS, F.floor(n % (_VOWELS * _TAILS) / _TAILS).cast("int"))
        tail = F.when(n % _TAILS == 0, "").otherwise(jamo(0x11A7, _TAILS, (n % _TAILS).cast("int")))
        return F.when(n.between(0, _HANGUL_LAST - _HANGUL), F.concat(lead, vowel, tail)).otherwise(out)

    def apply(self, c: Column) -> Column:
        """``c`` with every character replaced; a text that has none of them is only looked through."""
        longer = F.when(c.rlike(self._longer), F.array_join(F.transform(F.split(c, ""), self._expanded), "")).otherwise(c)
        return F.when(c.rlike(self._any), F.translate(longer, *self._one)).otherwise(c)


#: Plain letters.
PLAIN = Replacement({c: p for c in _characters() if (p := plain(c)) != c}, hangul=True)
#: What full case folding changes in lower-case text, but for the sharp s, which is frequent and replaced by itself.
FOLDED = Replacement({c: f for c in _characters() if c != "ß" and c.lower() == c and (f := c.casefold()) != c})
