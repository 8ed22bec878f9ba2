"""Toxicity by compression distance.

Two zstandard raw-content dictionaries are made of labelled texts, one of toxic and one of ordinary ones. A text is
cut into windows of words; what a window is longer by when it is compressed with the ordinary dictionary is its gain.
The largest gain of a text, looked up in shares measured on labelled texts of their own, gives its score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType

from lexspark.llm.common import crc_bucket, map_in_arrow, table, with_fields
from lexspark.session import Scratch

#: The bound of what is learned from: so many distinct texts of each label, those with the smallest hashes.
SAMPLE_TOXIC, SAMPLE_ORDINARY = 3_000, 9_000
#: Of the texts sampled, those whose hash is 0 modulo this calibrate, the others fill the dictionaries.
CALIBRATE_ONE_IN = 4
#: Ordinary text that both dictionaries hold: pieces of so many characters, as many as fit.
BASE_BYTES, PIECE_CHARS = 49_152, 384
#: Bytes of what a dictionary holds beyond that, and how many candidates the driver gets for them.
OWN_BYTES, MAX_CANDIDATES = 4_096, 4_000
#: Beginnings of words that may tell a class are between these lengths; whole words may be longer.
MIN_PREFIX, MAX_PREFIX, MAX_WHOLE = 3, 12, 32
#: Of the occurrences of such a piece, normalised by class, at least this share is toxic.
MIN_SHARE = 0.99
#: Words of a window; one that is longer than so many bytes is cut.
WINDOW_WORDS, WINDOW_BYTES = 1, 64
#: Both dictionaries end with the head, so that no block is too small to be compressed; matches that end less than
#: eight bytes before a block's end aren't looked for, hence the tail.
HEAD, TAIL = b"0123456789abcdef", b"\n" * 8
#: So many bytes of a word's beginning stand before it in capitals, in dictionaries and windows alike: a beginning that
#: only the inside of other words has is no match then, and words that begin alike are found quickly.
START_BYTES = 3
#: Bytes of text that are cut into windows at a time.
SLICE_BYTES = 1 << 20

_ASCII = r"[\x00-\x08\x0E-\x1F\x21-\x60\x7B-\x7F]"
_DROPPED = bytes(b for b in range(128) if not (chr(b).isalpha() or b in b" \t\n\v\f\r"))
_LETTERS = bytes.maketrans(b"\t\n\v\f\r", b"     ")


@dataclass(frozen=True)
class Model:
    """What scoring needs: the two dictionaries, and by rising least gain the share of toxic texts."""

    toxic: bytes
    ordinary: bytes
    gains: tuple[int, ...]
    shares: tuple[float, ...]


def _marked(word: bytes) -> bytes:
    return word[:START_BYTES].upper() + word


def _words(text: Column) -> Column:
    """Lower-cased words without ASCII digits and punctuation."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), _ASCII, ""), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, toxic: int, ordinary: int) -> DataFrame:
    """(text, toxic, h): of each label the distinct texts with the smallest hashes; a text with both labels is toxic.
    Only ids and hashes meet the labels and are ranked, first in groups and then the best of these."""
    h = F.xxhash64(F.col(text))
    known = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), h.alias("h")).join(labels.where(F.col(label).isNotNull()).select(F.col(doc_id).alias("id"), (F.col(label) != 0).alias("toxic")), "id")
    chosen = known.groupBy("h").agg(F.max("toxic").alias("toxic")).withColumn("group", F.pmod("h", F.lit(32)))
    most = F.when(F.col("toxic"), toxic).otherwise(ordinary)
    for keys in (["toxic", "group"], ["toxic"]):
        chosen = chosen.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("h"))).where(F.col("rank") <= most)
    chosen = chosen.select("h", "toxic")  # at most SAMPLE_TOXIC + SAMPLE_ORDINARY rows
    return docs.select(F.col(text).alias("text"), h.alias("h")).join(F.broadcast(chosen), "h").dropDuplicates(["h"])


def _pieces(sample: DataFrame) -> DataFrame:
    """(piece, a, b): beginnings of words and whole words with their occurrences in toxic and in ordinary texts.
    Occurrences between the same neighbours count once in a class, so copies of a passage speak with one voice."""
    w = F.concat(F.array(F.lit("")), _words("text"), F.array(F.lit("")))
    found = sample.select("toxic", w.alias("w")).where(F.size("w") > 2)
    n = F.size("w")
    found = found.select("toxic", F.inline(F.arrays_zip(F.slice("w", F.lit(2), n - 2).alias("word"), F.slice("w", F.lit(1), n - 2).alias("before"), F.slice("w", F.lit(3), n - 2).alias("after"))))
    seen = found.select("toxic", "word", F.xxhash64("before", "after").alias("around")).distinct().groupBy("toxic", "word").agg(F.count("*").alias("n"))
    lengths = F.sequence(F.lit(MIN_PREFIX), F.least(F.length("word"), F.lit(MAX_PREFIX)))
    cut = F.when(F.length("word") >= MIN_PREFIX, F.transform(lengths, lambda k: F.concat(F.lit(" "), F.substring("word", F.lit(1), k)))).otherwise(F.array().cast("array<string>"))
    whole = F.when(F.length("word").between(MIN_PREFIX, MAX_WHOLE), F.array(F.concat(F.lit(" "), "word", F.lit(" ")))).otherwise(F.array().cast("array<string>"))
    one = seen.select("toxic", "n", F.explode(F.concat(cut, whole)).alias("piece"))
    total = lambda kind: F.sum(F.when(F.col("toxic") == kind, F.col("n")).otherwise(0))
    return one.groupBy("piece").agg(total(True).alias("a"), total(False).alias("b"))


def _telling(pieces: DataFrame) -> list[str]:
    """Pieces that are commoner in toxic texts than chance explains, by the logarithm of the likelihood ratio; what is
    asked of it rises with the number of pieces looked at. Of pieces that contain one another the first stays."""
    whole = pieces.where(F.col("piece").endswith(" ")).agg(F.sum("a").alias("all_a"), F.sum("b").alias("all_b"), F.count("*").alias("n")).first()
    all_a, all_b = whole["all_a"] or 0, whole["all_b"] or 0
    if not all_a or not all_b:
        return []
    a, b, every = F.col("a"), F.col("b"), float(all_a + all_b)
    part = lambda k, of: F.when(k > 0, k * F.log(k / of)).otherwise(0.0)
    ratio = 2 * (part(a, (a + b) * (all_a / every)) + part(b, (a + b) * (all_b / every)))
    share = (a / all_a) / (a / all_a + b / all_b)
    # Length breaks ties: of two pieces that tell as much, the longer one saves more.
    best = pieces.where((a > 0) & (share >= MIN_SHARE)).withColumn("ratio", F.round(ratio, 6)).where(F.col("ratio") > 2 * math.log(whole["n"] * (MAX_PREFIX - MIN_PREFIX + 2)) + 4)
    rows = best.orderBy(F.col("ratio").desc(), F.length("piece").desc(), "piece").limit(MAX_CANDIDATES).select("piece").collect()
    kept: list[str] = []
    size = 0
    for r in rows:
        piece = r["piece"]
        if any(piece in k or k in piece for k in kept):
            continue
        size += len(piece.encode())
        if size > OWN_BYTES:
            break
        kept.append(piece)
    return kept


def _base(sample: DataFrame) -> bytes:
    """Pieces of ordinary texts, each from where its hash says."""
    h = F.col("h")
    begin = F.pmod(h, F.greatest(F.lit(1), F.length("text") - PIECE_CHARS + 1)) + 1
    piece = F.substring(F.col("text"), begin.cast("int"), F.lit(PIECE_CHARS))
    rows = sample.where(~F.col("toxic")).orderBy("h").limit(4 * BASE_BYTES // PIECE_CHARS).select(piece.alias("piece")).collect()
    return b"".join(_marked(w) + b" " for r in rows for w in _normal(r["piece"]).split())[:BASE_BYTES]


def _dictionaries(base: bytes, telling: list[str]) -> tuple[bytes, bytes]:
    """Both hold the base. The toxic one then has the telling pieces, the best at the end; the ordinary one in their
    place what ordinary text has of their insides, so that these match equally well in both."""
    own = [_marked(p[1:].encode()) for p in reversed(telling)]
    inside = []
    for p in own:
        start, parts, reach = 0, [], 0
        while start < len(p):
            end = start
            while end < len(p) and p[start : end + 1] in base:
                end += 1
            if end - start >= 3 and end > reach:
                parts.append(p[start:end])
                reach = end
            start += 1
        inside.append(b"\n".join(parts))
    toxic, ordinary = b"\n".join(own), b"\n".join(inside)
    room = max(len(toxic), len(ordinary))
    return tuple(base + own.rjust(room, b"\n") + HEAD for own in (toxic, ordinary))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample_toxic: int = SAMPLE_TOXIC, sample_ordinary: int = SAMPLE_ORDINARY, window: int = WINDOW_WORDS) -> Model:
    """A model of the documents that have labels; those with a null id, text or label don't count, and of several labels
    of a text any that isn't 0 makes it toxic.

    Learned from at most ``sample_toxic`` distinct texts whose label isn't 0 and ``sample_ordinary`` of label 0, whole
    and of any length. Pieces are counted in Spark; the driver gets at most ``MAX_CANDIDATES`` of them, pieces of
    ordinary texts of about 4 * ``BASE_BYTES``, and a count by gain. Without texts of both labels every score is 0."""
    held = Scratch(docs.sparkSession)
    sample = held.table(_sample(docs, labels, doc_id, text, label, sample_toxic, sample_ordinary), "toxicity-sample")
    calibrates = F.pmod(F.shiftright("h", 7), F.lit(CALIBRATE_ONE_IN)) == 0
    fitted = sample.where(~calibrates)
    pieces = held.table(_pieces(fitted), "toxicity-pieces")
    model = Model(*_dictionaries(_base(fitted), _telling(pieces)), (0,), (0.0,))
    counts = score(sample.where(calibrates).select("text", F.col("toxic").alias("__toxic")), model, window=window).groupBy("gain").agg(F.count("*").alias("n"), F.sum(F.col("__toxic").cast("long")).alias("toxic")).collect()
    held.keep()
    return Model(model.toxic, model.ordinary, *_calibrated({r["gain"]: (r["toxic"], r["n"]) for r in counts}))


def _calibrated(counts: dict[int, tuple[int, int]]) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """Least gains and shares of toxic texts that rise with them: neighbours that fall are put together. A share
    starts from that of all texts, counted as half a text."""
    n, toxic = sum(c[1] for c in counts.values()), sum(c[0] for c in counts.values())
    prior = toxic / n if n else 0.0
    blocks: list[list[float]] = []
    for gain in sorted(counts):
        blocks.append([gain, counts[gain][0] + 0.5 * prior, counts[gain][1] + 0.5])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], blocks[-1][1] + last[1], blocks[-1][2] + last[2]]
    return tuple(int(b[0]) for b in blocks) or (0,), tuple(b[1] / b[2] for b in blocks) or (0.0,)


def _normal(text: str) -> bytes:
    """Lower-cased UTF-8 without ASCII digits and punctuation, white space as spaces."""
    return text.lower().encode().translate(_LETTERS, _DROPPED)


def _slices(data: bytes) -> Iterator[bytes]:
    """Pieces of about ``SLICE_BYTES`` that end between words."""
    at = 0
    while at < len(data):
        end = data.find(b" ", at + SLICE_BYTES)
        end = len(data) if end < 0 else end
        yield data[at:end]
        at = end


def _windows(words: list[bytes], n: int) -> list[bytes]:
    """Windows of ``n`` words at every word; long ones in parts."""
    if n > 1:
        words = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    if max(map(len, words), default=0) <= WINDOW_BYTES:
        return words
    return [w[i : i + WINDOW_BYTES] for w in words for i in range(0, len(w), WINDOW_BYTES)]


class _Scorer:
    def __init__(self, model: Model, window: int):
        # A lazy parse: sizes then differ by what is matched alone. Optimal parsers weigh prices, which differ by dictionary.
        params = zstandard.ZstdCompressionParameters(window_log=17, hash_log=16, chain_log=17, search_log=8, min_match=4, target_length=32, strategy=zstandard.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        self.window, self.by = window, []
        for content in (model.ordinary, model.toxic):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.by.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))

    def gains(self, windows: list[bytes]) -> np.ndarray:
        """What each window gains by the toxic dictionary."""
        mark = (lambda w: b" ".join(map(_marked, w.split(b" ")))) if self.window > 1 else _marked
        blocks = [HEAD + mark(w) + b" " + TAIL for w in windows]
        sizes = [np.fromiter((len(c.compress(b)) for b in blocks), np.int32, len(blocks)) for c in self.by]
        return sizes[0] - sizes[1]

    def best(self, texts: list[str | None]) -> tuple[np.ndarray, list[str | None]]:
        """The largest gain of each text, at least 0, and the first window that has it. A window is compressed once,
        however often a batch has it."""
        gains, found = np.zeros(len(texts), np.int32), [None] * len(texts)
        held: list[bytes] = []
        owners: list[int] = []
        counts: list[int] = []

        def done() -> None:
            if held:
                coded = pa.array(held, pa.binary()).dictionary_encode()
                distinct = coded.dictionary.to_pylist()
                g = self.gains(distinct)[coded.indices.to_numpy()]
                starts = np.cumsum([0, *counts[:-1]])
                for owner, start, n, most in zip(owners, starts, counts, np.maximum.reduceat(g, starts)):
                    if most > gains[owner]:
                        gains[owner] = most
                        found[owner] = held[start + int(np.argmax(g[start : start + n]))].decode(errors="replace")
            held.clear(), owners.clear(), counts.clear()

        for k, text in enumerate(texts):
            for piece in _slices(_normal(text)) if text else ():
                windows = _windows(piece.split(), self.window)
                if windows:
                    held += windows
                    owners.append(k)
                    counts.append(len(windows))
                if len(held) > SLICE_BYTES:
                    done()
        done()
        return gains, found


def score(docs: DataFrame, model: Model, text: str = "text", window: int = WINDOW_WORDS) -> DataFrame:
    """Adds gain, score (0 to 1), predicted (1 from 0.5 on) and worst (the first window with the largest gain) to every
    row; columns of these names are replaced. Whole texts of any length are read, in slices.

    Null and empty texts and those without a letter gain 0 and have no worst window; they get the score of texts
    that gain nothing. Equal texts get equal scores."""
    docs = docs.drop("gain", "score", "predicted", "worst")
    held = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of at most 64 KB
    schema = with_fields(docs, gain=IntegerType(), score=DoubleType(), predicted=IntegerType(), worst=StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(held.value, window)
        levels, shares = np.array(held.value.gains), np.array(held.value.shares)
        for b in batches:
            gains, worst = scorer.best(b.column(b.schema.get_field_index(text)).to_pylist())
            s = shares[np.maximum(np.searchsorted(levels, gains, side="right") - 1, 0)]
            columns = [*b.columns, pa.array(gains, pa.int32()), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32)), pa.array(worst, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names, "gain", "score", "predicted", "worst"])

    return map_in_arrow(docs, run, schema)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, by labels of those not held out; nulls and empty texts as in ``score``, labels as
    in ``fit``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_bucket(F.col("doc_id"), 5) == 0
    model = fit(docs.where(~held_out), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score(docs.withColumn("held_out", held_out), model).select("doc_id", "held_out", "score", "predicted", "gain", "worst")
