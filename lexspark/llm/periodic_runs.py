"""Periodic runs of words: stretches that repeat a few words over and over.

A run of period p and three periods or more has the words i and i + p equal for 2 * p places i in a row, so one of these
places is on a grid of that step. For all periods and all grid points of many texts at once, hashes of word sequences
say by binary search how far the words before and behind go on being equal; the sum of n / p over all periods is
about n log n. What is long enough is compared word by word and kept with its smallest period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from lexspark.llm.common import WORD, map_in_arrow, table, with_fields
from lexspark.llm.polyhash import Sequences

#: A run has at least so many words, and so many times its period.
MIN_WORDS, MIN_PERIODS = 24, 3
#: Words of texts that are searched together, and pairs of a period and a grid point that are looked at together.
CHUNK_WORDS, CHUNK_PAIRS = 1 << 18, 1 << 20

RUN = StructType([StructField("start", LongType()), StructField("length", LongType()), StructField("period", LongType())])


def _pairs(starts: np.ndarray, ends: np.ndarray, min_words: int, min_periods: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(i, p, start, end): places i and periods p to be looked at in the texts at ``starts`` to ``ends``, so many at a
    time. The step of the grid is the least number of places that a run of this period covers."""
    n = ends - starts
    least = lambda p: np.maximum(min_words, min_periods * p)
    # Texts by falling length: those with room for a period come first.
    order = np.argsort(-n, kind="stable")
    starts, ends, n = starts[order], ends[order], n[order]
    longest = int(n[0]) // min_periods if len(n) and n[0] >= min_words else 0
    texts_of = np.searchsorted(-n, -least(np.arange(1, longest + 1)), side="right")
    p = 1
    while p <= longest:
        # As many periods as come to CHUNK_PAIRS; one at least, cut below.
        room = np.cumsum(texts_of[p - 1 :] + np.int64(n.sum()) // np.maximum(1, least(np.arange(p, longest + 1)) - np.arange(p, longest + 1)))
        q = p + max(1, int(np.searchsorted(room, CHUNK_PAIRS, side="right")))
        periods = np.arange(p, min(q, longest + 1))
        k = texts_of[periods - 1]
        each = np.repeat(periods, k)
        text = np.arange(len(each)) - np.repeat(np.cumsum(k) - k, k)
        step = least(each) - each
        count = (n[text] - each - 1) // step + 1
        row = np.repeat(np.arange(len(each)), count)
        j = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        yield starts[text][row] + j * step[row], each[row], starts[text][row], ends[text][row]
        p = int(periods[-1]) + 1


def _reach(at: Sequences, a: np.ndarray, b: np.ndarray, room: np.ndarray, back: bool) -> np.ndarray:
    """How far the words at ``a`` and ``b`` go on being equal, at most ``room``: by binary search for all pairs at once.
    Never too small; where a hash errs, too large."""
    low, high = np.zeros(len(a), np.int64), room.copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        mid = (low[open_] + high[open_] + 1) >> 1
        x, y = a[open_], b[open_]
        same = at.of(x - mid, x) == at.of(y - mid, y) if back else at.of(x, x + mid) == at.of(y, y + mid)
        low[open_] = np.where(same, mid, low[open_])
        high[open_] = np.where(same, high[open_], mid - 1)


def _exact(ids: np.ndarray, start: int, end: int, i: int, p: int) -> tuple[int, int]:
    """The stretch of period p around i in ids[start:end], word by word."""
    differs = np.flatnonzero(ids[start : end - p] != ids[start + p : end]) + start
    k = int(np.searchsorted(differs, i))
    return (int(differs[k - 1]) + 1 if k else start), (int(differs[k]) + p if k < len(differs) else end)


def runs_of(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> np.ndarray:
    """Rows (start, end, period) of all runs in the texts at ids[starts:ends], by start, then period."""
    found = [np.zeros((0, 6), np.int64)]
    at = Sequences(ids)
    for i, p, start, end in _pairs(starts, ends, min_words, min_periods):
        # Words apart by a period are mostly different: what isn't equal at the grid point itself goes first.
        hit = np.flatnonzero(ids[i] == ids[i + p])
        i, p, start, end = i[hit], p[hit], start[hit], end[hit]
        first = i - _reach(at, i, i + p, i - start, back=True)
        last = i + p + _reach(at, i, i + p, end - (i + p), back=False)
        rows = np.stack([first, last, p, i, start, end], 1)[last - first >= np.maximum(min_words, min_periods * p)]
        # Grid points of one stretch and period follow one another; the first will do.
        found.append(rows[_new(rows[:, :3])])
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    runs: dict[tuple[int, int], int] = {}
    for group in np.split(rows, np.flatnonzero(_new(rows[:, :2]))[1:]):
        for first, last, p, i, start, end in group[:1].tolist():
            if _holds(ids, first, last, p, start, end):
                runs[first, last] = min(p, runs.get((first, last), p))
                # A longer period of the same stretch is a multiple of the smallest, or a hash has erred.
                group = group[group[:, 2] % p != 0]
        for first, last, p, i, start, end in group.tolist():
            first, last = _exact(ids, start, end, i, p)
            if last - first >= max(min_words, min_periods * p):
                runs[first, last] = min(p, runs.get((first, last), p))
    out = sorted((first, p, last) for (first, last), p in runs.items())
    return np.array([(first, last, p) for first, p, last in out], np.int64).reshape(-1, 3)


def _new(rows: np.ndarray) -> np.ndarray:
    """Which rows differ from the one before."""
    return np.concatenate([np.ones(min(1, len(rows)), bool), (rows[1:] != rows[:-1]).any(axis=1)])


def _holds(ids: np.ndarray, first: int, last: int, p: int, start: int, end: int) -> bool:
    """Whether ids[first:last] has the period and can't be extended."""
    inside = np.array_equal(ids[first : last - p], ids[first + p : last])
    return inside and (first == start or ids[first - 1] != ids[first - 1 + p]) and (last == end or ids[last] != ids[last - p])


def _runs_and_rest(texts: list[str | None], min_words: int, min_periods: int) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """For each text its runs (start, length, period) and the words that no run repeats, joined by one space."""
    words = [t.encode().split() if t else [] for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    ids = pa.array([x for w in words for x in w], pa.large_binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    rows = runs_of(ids, starts, ends, min_words, min_periods)
    owner = np.searchsorted(ends, rows[:, 0], side="right")
    by_text: dict[int, list[tuple[int, int, int]]] = {}
    for k, (first, last, p) in zip(owner.tolist(), rows.tolist()):
        by_text.setdefault(k, []).append((first - int(starts[k]), last - first, p))
    for k, w in enumerate(words):
        runs = by_text.get(k, [])
        if runs:
            keep = np.ones(len(w), bool)
            for first, length, p in runs:
                keep[first + p : first + length] = False
            w = [w[x] for x in np.flatnonzero(keep).tolist()]
        yield runs, b" ".join(w)


def _chunks(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Texts that have about ``CHUNK_WORDS`` words together; a longer one alone."""
    held, size = [], 0
    for t in texts:
        n = len(t) // 5 if t else 0
        if held and size + n > CHUNK_WORDS:
            yield held
            held, size = [], 0
        held.append(t)
        size += n
    if held:
        yield held


def find_runs(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> DataFrame:
    """Adds runs, an array of (start, length, period) by start, then period, and collapsed, the text's words without
    those that a run repeats, joined by one space. Columns of these names are replaced.

    A run is a stretch of at least ``min_words`` words and ``min_periods`` (two or more) times its smallest period that
    can't be extended. A null, empty or short text has no runs; a null text collapses to an empty one. A text of any
    length is searched whole, in memory that grows with it."""
    if min_periods < 2 or min_words < 2:
        raise ValueError("a run repeats its words: min_periods and min_words must be 2 or more")
    docs = docs.drop("runs", "collapsed")
    schema = with_fields(docs, runs=ArrayType(RUN), collapsed=StringType())
    run_type = pa.list_(pa.struct([(n, pa.int64()) for n in RUN.names]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, rest = [], []
            for texts in _chunks(b.column(b.schema.get_field_index(text)).to_pylist()):
                for runs, words in _runs_and_rest(texts, min_words, min_periods):
                    found.append([dict(zip(RUN.names, r)) for r in runs])
                    rest.append(words.decode())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, run_type), pa.array(rest, pa.string())], names=[*b.schema.names, "runs", "collapsed"])

    return map_in_arrow(docs, run, schema)


def _with_period(doc_id: Column, text: Column) -> Column:
    """The texts that ``op13_periodic_runs`` searches: of one in ten the words from a place on repeat."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)
    n = F.size(words).cast("long")
    a = F.pmod(g, F.greatest(n, F.lit(1)))
    p = F.lit(1) + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))).cast("long")
    # A struct of its own, so that the words are found once.
    s = F.struct(words.alias("w"), a.alias("a"), p.alias("p"))
    again = F.element_at(F.transform(F.array(s), lambda x: F.array_join(F.transform(x["w"], lambda w, i: F.when(i < x["a"], w).otherwise(F.get(x["w"], (x["a"] + F.pmod(i - x["a"], x["p"])).cast("int")))), " ")), 1)
    return F.when((F.pmod(h, F.lit(10)) == 0) & (F.regexp_count(text, F.lit(WORD)) > 0), again).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document, digested; nulls and empty texts as in ``find_runs``, a null id counts as empty text.
    Exponents are compared as fractions: length * other period, within 64 bits."""
    docs = table(spark, sf_dir, "documents").select("doc_id", _with_period(F.col("doc_id"), F.col("text")).alias("text"))
    found = find_runs(docs).select("doc_id", "runs", "collapsed")
    key = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(key(r), F.lit("\n"))), "")
    greater = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    # By start, then period: only a truly greater exponent replaces what was first.
    best = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)), lambda x, y: F.when(greater(y, x), y).otherwise(x))
    out = found.withColumn("best", F.when(F.size("runs") > 0, best))
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col("best")[n].alias(n) for n in RUN.names],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
