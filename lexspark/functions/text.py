"""Text expressions: Column in, Column out, all inside the JVM. Null input counts as the empty string."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexspark.functions.letters import FOLDED, PLAIN

#: White space as Python's str.split sees it: Unicode's White_Space and four control characters.
SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"

#: Words that carry no meaning in a query, and stop words of the fallback keywords.
QUERY_NOISE = ("hs", "hs6", "hs8", "hs10", "hs12", "hts", "tariff", "code", "codes", "classification", "classify", "search", "find")
STOP_WORDS = ("and", "or", "of", "the", "a", "an", "for", "with", "without", "whether", "not", "other")
#: Descriptions that say nothing.
GENERIC = ("other", "other: other", "seed", "other fruit, fresh. - other")

#: Code point ranges whose letters keywords may use (Latin, Devanagari, Arabic, Cyrillic).
SCRIPTS = (
    (0x00C0, 0x024F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xAB30, 0xAB6F),
    (0x0900, 0x097F), (0xA8E0, 0xA8FF), (0x11B00, 0x11B5F),
    (0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF),
    (0x0400, 0x052F), (0x1C80, 0x1C8F), (0xA640, 0xA69F),
)
#: Characters that are cut from the ends of keywords, and of fallback keywords.
KEYWORD_EDGE = " \t\n\r\"'`“”‘’.,;:()[]{}<>|\\/"
TOKEN_EDGE = ".,;:()[]{}'\""

Text = Column | str


def _c(c: Text) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def casefold(c: Text) -> Column:
    """Full case folding: lower case for comparison; the German sharp s counts as ss."""
    return FOLDED.apply(F.replace(F.lower(_c(c)), F.lit("ß"), F.lit("ss")))


def norm_space(c: Text) -> Column:
    """Every run of white space is one space; none at the ends."""
    return F.trim(F.regexp_replace(_c(c), SPACE + "+", " "))


def strip_bullets(c: Text) -> Column:
    return F.regexp_replace(_c(c), f"^[-–—]{{1,3}}{SPACE}*", "")


def strip_emphasis(c: Text) -> Column:
    return norm_edges(F.regexp_replace(_c(c), "[*_]+", ""))


def norm_edges(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def drop_dot_leaders(c: Text) -> Column:
    return norm_space(F.regexp_replace(_c(c), r"\.{2,}", " "))


def clean_description(c: Text, bullets: bool = False) -> Column:
    return norm_edges(strip_bullets(norm_space(c))) if bullets else norm_space(c)


def clean_prefix(c: Text, bullets: bool = False) -> Column:
    return F.rtrim(clean_description(c, bullets), F.lit(" .:;,-"))


def join_descriptions(prefix: Text, desc: Text, bullets: bool = False) -> Column:
    """Prefix and description as one text, unless one of them already says what the other does."""
    p, d = clean_prefix(prefix, bullets), clean_description(desc, bullets)
    return (
        F.when(p == "", d)
        .when(d == "", p)
        .when(F.contains(F.lower(d), F.lower(p)), d)
        .when(F.contains(F.lower(p), F.lower(d)), p)
        .otherwise(clean_description(F.concat(p, F.lit(" "), d), bullets))
    )


def looks_like_rate(c: Text) -> Column:
    """A duty rate rather than a description. Any text with the letters ``free`` counts, "freestone" too."""
    return F.contains(F.lower(_c(c)), F.lit("free")) | _c(c).rlike("[%¢]")


def is_meaningful_prefix(c: Text) -> Column:
    d = drop_dot_leaders(c)
    return (F.length(d) >= 8) & ~looks_like_rate(d) & ~d.rlike("(?i)^other:?$") & d.rlike("[A-Za-z]")


def needs_rewrite_row(code: Text, desc: Text, country: Text) -> Column:
    """Rows a language model should rewrite: national codes, headings of national tariffs, thin descriptions."""
    n, d = F.length(F.regexp_replace(_c(code), "[^0-9]", "")), norm_space(desc)
    thin = (d == "") | d.rlike(r"(?i)^other:?\.?$") | looks_like_rate(d) | (F.size(F.split(d, " ")) <= 3) | (F.length(d) < 25)
    return ((_c(country) != "") & ((n > 8) | (n == 4))) | thin


def looks_generic(c: Text) -> Column:
    return F.trim(F.lower(norm_space(c))).isNotNull() & F.btrim(F.lower(norm_space(c)), F.lit(" .:")).isin(*GENERIC)


def needs_description_rewrite(c: Text, threshold: int = 80) -> Column:
    d = norm_space(c)
    return (d == "") | looks_generic(d) | (F.length(d) < threshold)


def stable_distinct(items: Column, limit: int, key=casefold) -> Column:
    """The first of all items with equal keys, in order, at most ``limit`` of them: one pass over the items."""
    keyed = F.transform(items, lambda x: F.struct(key(x).alias("k"), x.alias("v")))
    kept = F.aggregate(
        keyed,
        F.array().cast("array<struct<k:string,v:string>>"),
        lambda acc, x: F.when((F.size(acc) >= limit) | F.exists(acc, lambda y: y["k"] == x["k"]), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return F.transform(kept, lambda x: x["v"])


def segments(c: Text, limit: int = 10) -> Column:
    """Parts between colons, without continuation marks, each once, in order."""
    d = F.replace(F.replace(norm_space(c), F.lit("(con.)"), F.lit(" ")), F.lit("(con )"), F.lit(" "))
    parts = F.filter(F.transform(F.split(d, ":"), norm_space), lambda x: x != "")
    return stable_distinct(parts, limit)


def allowed_scripts(c: Text) -> Column:
    """No letter outside ASCII and the ranges of SCRIPTS; marks, digits and punctuation don't matter."""
    ranges = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in SCRIPTS)
    return ~_c(c).rlike(rf"[\p{{L}}&&[^\x00-\x7F{ranges}]]")


def clean_keyword(c: Text) -> Column:
    """A keyword fit for the index, or null."""
    s = norm_space(c)
    s = F.when(F.startswith(F.lower(s), F.lit("keywords:")), norm_space(F.substring(s, 10, 1 << 30))).otherwise(s)
    s = norm_space(F.btrim(s, F.lit(KEYWORD_EDGE)))
    return F.when((F.length(s) >= 2) & allowed_scripts(s), s)


#: Items that are looked at first, for each one that is wanted; where they don't do, all are.
LOOK_AHEAD = 4


def _first_of(items: Column, limit: int, clean) -> Column:
    """``clean(items)``, which gives the first ``limit`` of what it keeps: from the first items if those give as many."""
    items = F.array_distinct(F.coalesce(items, F.array().cast("array<string>")))
    # The first ``limit`` of the beginning are the first of all; so the rest is read only where they are fewer.
    ahead = F.transform(F.array(clean(F.slice(items, 1, LOOK_AHEAD * limit))), lambda x: F.when((F.size(x) >= limit) | (F.size(items) <= LOOK_AHEAD * limit), x))
    return F.coalesce(F.get(ahead, F.lit(0)), clean(items))


def clean_keywords(items: Column, limit: int) -> Column:
    """Cleaned keywords, each once whatever its case, the first ``limit``."""
    return _first_of(items, limit, lambda x: _cleaned(x, limit))


def _cleaned(items: Column, limit: int) -> Column:
    # Each step is bound once, as Spark computes a shared expression inside a lambda again at every use.
    s = F.transform(items, norm_space)
    s = F.transform(s, lambda x: F.regexp_replace(x, "(?i)^keywords:", ""))
    s = F.transform(s, lambda x: F.btrim(x, F.lit(KEYWORD_EDGE)))
    s = F.transform(s, norm_space)
    return stable_distinct(F.filter(s, lambda x: (F.length(x) >= 2) & allowed_scripts(x)), limit)


def fallback_keywords(c: Text, limit: int = 8, stop: tuple[str, ...] = STOP_WORDS, colons: bool = False, context: Column | None = None) -> Column:
    """Words of a text, then of the texts of its ``context``, as keywords where no model gave any: three letters at
    least, no stop words, each once."""
    d = norm_space(c if context is None else F.concat_ws(" ", _c(c), context))
    d = norm_space(F.replace(d, F.lit(":"), F.lit(" "))) if colons else d

    def kept(words: Column) -> Column:
        words = F.transform(words, lambda x: norm_edges(F.btrim(x, F.lit(TOKEN_EDGE))))
        return stable_distinct(F.filter(words, lambda x: (F.length(x) >= 3) & (~casefold(x).isin(*stop) if stop else F.lit(True))), limit)

    return _first_of(F.split(d, " "), limit, kept)


def term_keywords(term: Text, id: Text) -> Column:  # noqa: A002
    """The term itself as its keyword, or its id where it is empty; none where both are."""
    said = norm_space(F.coalesce(F.nullif(_c(term), F.lit("")), _c(id)))
    return F.filter(F.array(said), lambda x: x != "")


def attribute_keywords(product: Text, kind: Text, value: Text, said: Text) -> Column:
    """Words of a product, an attribute's type and value, and a text, as keywords where no model gave any."""
    return fallback_keywords(F.concat_ws(" ", *map(_c, (product, kind, value, said))), 10, (), colons=True)


def tokens(c: Text) -> Column:
    """Distinct runs of letters and digits, case-folded."""
    return F.array_distinct(F.regexp_extract_all(casefold(c), F.lit(r"([\p{L}\p{N}]+)"), 1))


def query_tokens(c: Text) -> Column:
    return F.array_except(tokens(c), F.array(*map(F.lit, QUERY_NOISE)))


def fold(c: Text) -> Column:
    """Compatibility decomposition without combining marks, for every script."""
    return PLAIN.apply(_c(c))


def token_variants(token: Column) -> Column:
    """The token, its folded form, and either without a plural s."""
    # A lambda's argument is computed once, a repeated expression inside another lambda at every use.
    forms = F.array_distinct(F.flatten(F.transform(F.array(casefold(token)), lambda t: F.array(t, fold(t)))))
    singular = lambda v: v.rlike("^[\\x00-\\x7F]{3,}s$") & ~v.rlike("ss$")
    cut = F.transform(F.filter(forms, singular), lambda v: F.substring(v, F.lit(1), F.length(v) - 1))
    return F.filter(F.array_distinct(F.concat(forms, cut)), lambda v: v != "")


def normalized_tokens(c: Text) -> Column:
    return F.array_distinct(F.flatten(F.transform(tokens(c), token_variants)))


def overlap_tokens(query: Text, *candidate: Text) -> Column:
    """Token variants of three letters or more that a query shares with the candidate's texts."""
    q = F.array_except(F.filter(normalized_tokens(query), lambda t: F.length(t) >= 3), F.array(*map(F.lit, QUERY_NOISE)))
    c = F.filter(normalized_tokens(F.concat_ws(" ", *[_c(x) for x in candidate])), lambda t: F.length(t) >= 3)
    return F.array_intersect(q, c)


def search_text(*parts: Text, keywords: Column | None = None) -> Column:
    """The text that is indexed: non-empty parts, then the keywords."""
    kept = [F.nullif(norm_space(p), F.lit("")) for p in parts]
    if keywords is not None:
        kept.append(F.when(F.size(keywords) > 0, F.concat(F.lit("Keywords: "), F.array_join(keywords, ", "))))
    return norm_space(F.concat_ws(" ", *kept))


def cache_id(c: Text) -> Column:
    """Old delimiters of cache ids become tabs."""
    return F.translate(_c(c), "\x00\n\r", "\t\t")


def is_country_specific(path: Text) -> Column:
    return F.array_contains(F.split(F.lower(_c(path)), "/"), "country specific")


def country_of_path(path: Text) -> Column:
    return F.when(F.contains(F.lower(F.element_at(F.split(_c(path), "/"), -1)), F.lit("hts")), "US").otherwise("UNKNOWN")


def infer_country(path: Text, first_page: Text) -> Column:
    """Null outside country-specific folders; else by file name, else by the first page's text."""
    named = country_of_path(path)
    by_text = F.when(F.contains(F.lower(_c(first_page)), F.lit("united states")), "US").otherwise("UNKNOWN")
    return F.when(is_country_specific(path), F.when(named == "US", named).otherwise(by_text))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
