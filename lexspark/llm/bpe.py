"""Byte-level BPE by prefix-sharing trie traversal.

A text falls into words by the vocabulary's split pattern, and each distinct word is encoded once per batch. The
distinct words form a trie, walked depth first in sorted order: the nodes a word shares with the one before it
keep their states. The state of a node is the last token of the encoding of its prefix: the one token that ends
there and may follow the last token of the prefix before it. Following these states back from a word's last node
gives its encoding, so what words share is worked out once.

Two tokens may follow each other if undoing the merges that made them, newest first, never meets a merge across
their border that would have come earlier.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from lexspark.llm.common import map_in_arrow, table, with_fields

#: Fixed value: the split pattern of this family of vocabularies, with \s as Unicode's White_Space.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
#: A worker forgets its words when it holds so many; longer words are never kept. It remembers so many pairs of tokens.
#: Workers outlive their tasks, and so does this memory. None of it alters a result.
CACHE_WORDS, CACHE_WORD_BYTES, CACHE_PAIRS = 200_000, 64, 250_000
#: Characters of text that are encoded at a time. The words of a slice are held one by one, so that a worker's memory
#: goes with it: what a worker has once taken for them it keeps.
SLICE_CHARS = 250_000


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that the vocabulary file uses for bytes: visible Latin-1 characters stand for
    themselves, the other bytes in ascending order for U+0100 onwards."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    other = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """Tokens as bytes, merges by rank, and added tokens that are matched in the text before it is split."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = _byte_of_char()
        raw = lambda token: bytes(to_byte[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.id_of = {raw(t): i for t, i in vocab.items()}
        self.bytes_of = {i: b for b, i in self.id_of.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for k, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            pair = (vocab[a], vocab[b])
            self.rank[pair] = k
            self.parts.setdefault(vocab[a + b], (k, *pair))
        self.longest = max(map(len, self.id_of), default=1)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        self.packed = {i: i.to_bytes(4, "little") for i in self.bytes_of}
        added = "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))
        self.find_added = regex.compile(f"({added})") if added else None
        self.split = regex.compile(SPLIT)
        self.words: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    def may_follow(self, left: int, right: int) -> bool:
        limit = len(self.rank)
        while True:
            # A merge of the two tokens that would have come before what formed either of them rules them out.
            if self.rank.get((left, right), limit) < limit:
                return False
            l, r = self.parts.get(left), self.parts.get(right)
            if l is None and r is None:
                return True
            # Merges of one rank go from left to right: of two such, the right one is the newer.
            if r is None or l is not None and l[0] > r[0]:
                limit, left = l[0], l[2]
            else:
                limit, right = r[0] + 1, r[1]

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Distinct words and their ids as little-endian unsigned 32-bit integers."""
        out: dict[str, bytes] = {}
        get, packed, longest = self.id_of.get, self.packed, self.longest
        if len(self.pairs) > CACHE_PAIRS:
            self.pairs.clear()
        follows, n_ids = self.pairs, max(self.bytes_of, default=0) + 1
        before, token, size = b"", [0], [0]  # states of the path to the word before: last token, its length
        for data, word in sorted((w.encode(), w) for w in words):
            n, shared = len(data), 0
            for x, y in zip(data, before):
                if x != y:
                    break
                shared += 1
            del token[shared + 1 :], size[shared + 1 :]
            for end in range(shared + 1, n + 1):
                for start in range(max(0, end - longest), end):
                    t = get(data[start:end])
                    if t is None:
                        continue
                    if start:
                        pair = token[start] * n_ids + t
                        may = follows.get(pair)
                        if may is None:
                            may = follows[pair] = self.may_follow(token[start], t)
                        if not may:
                            continue
                    token.append(t)
                    size.append(end - start)
                    break
                else:
                    raise ValueError(f"no token ends at byte {end} of {word!r}")
            ids, end = [], n
            while end:
                ids.append(packed[token[end]])
                end -= size[end]
            ids.reverse()
            out[word] = b"".join(ids)
            before = data
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        split = [[(p, None) if p in self.added else (p, self.split.findall(p)) for p in (self.find_added.split(t) if self.find_added else [t]) if p] for t in texts]
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        known = self.words
        new = {w for parts in split for _, ws in parts if ws for w in ws if w not in known}
        coded = self.encode_words(list(new))
        long = {w: c for w, c in coded.items() if len(w) > CACHE_WORD_BYTES}
        known.update((w, c) for w, c in coded.items() if w not in long)
        of = (known | long).__getitem__ if long else known.__getitem__
        return [b"".join([self.packed[self.added[p]] if ws is None else b"".join(map(of, ws)) for p, ws in parts]) for parts in split]

    def decode(self, packed: bytes) -> str:
        """The text behind packed ids; bytes that are no UTF-8 become U+FFFD."""
        ids = memoryview(packed).cast("I") if packed else ()
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """One per worker and file."""
    return Vocabulary(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    at, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t)
        if chars >= SLICE_CHARS:
            yield at, i + 1
            at, chars = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def encoded(v: Vocabulary, texts: list[str]) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first, end, packed ids) of runs of texts; only one run's words are held at a time."""
    for lo, hi in _slices(texts):
        yield lo, hi, v.encode_batch(texts[lo:hi])


def encode(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Adds column ``ids``: the text's token ids as binary, little-endian unsigned 32-bit integers; with
    ``decoded``, also the text that these ids decode to. Columns of these names are replaced.

    ``path``: a vocabulary file that every executor has; default: the public byte_bpe_50k.json. A null text is
    encoded as the empty one: no ids. Equal texts give equal ids; texts of any length are encoded whole."""
    new = [ids] + ([decoded] if decoded else [])
    docs = docs.drop(*new)
    schema = with_fields(docs, **{ids: BinaryType()}, **({decoded: StringType()} if decoded else {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path or default_path())
        for b in batches:
            texts = [t or "" for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            for lo, hi, coded in encoded(v, texts):
                columns = [*b.slice(lo, hi - lo).columns, pa.array(coded, pa.binary())]
                if decoded:
                    columns.append(pa.array(map(v.decode, coded), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names, *new])

    return map_in_arrow(docs, run, schema)


def decode(rows: DataFrame, path: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds column ``text``: what the packed ids decode to; null ids decode to the empty text."""
    rows = rows.drop(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path or default_path())
        for b in batches:
            texts = [v.decode(i or b"") for i in b.column(b.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, text])

    return map_in_arrow(rows, run, with_fields(rows, **{text: StringType()}))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: how many tokens, and hashes of ids and decoded text. A null text counts as the empty one,
    which has no tokens; repeated rows each have their row; an empty table has none. Texts of any length are encoded
    whole."""
    rows = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded="decoded")
    return rows.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
