"""Mixing sources to target weights by hash-threshold histograms.

Each row has a hash; a source takes every whole pass that its target allows and, of one further pass, the
rows whose hash lies under a threshold. Thresholds come from histograms of words by source and hash bucket;
only the bucket in which the budget ends is split again. Nothing is sorted and nothing is sampled; the rows
of a smaller budget are always among those of a larger one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from lexspark.llm.common import hash60, map_in_arrow, table, with_fields, word_count
from lexspark.session import materialise

#: Bits of a row's hash and of one histogram level.
HASH_BITS, LEVEL_BITS = 60, 12
#: A table of one row per source is broadcast up to this many sources; beyond it Spark joins by shuffle.
BROADCAST_SOURCES = 50_000


def source_targets(sizes: DataFrame, weights: Sequence[float], budget: float, cap: float) -> DataFrame:
    """``sizes``: one row per source (source, source_size). Adds ``target``: the share of ``budget`` times all
    sizes by weight, where no target exceeds ``cap`` times its source's size and what is over is shared again.

    Weights are dealt to the sources in code point order, null last, and repeat. With sources ordered by
    cap / weight, those that end at their cap come first, so one running sum finds the level of the rest."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(n)) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(cap))).withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("all_size", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("left", F.col("all_size") * F.lit(float(budget)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    )
    level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(everything)["level"]
    return rows.select("source", "source_size", F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap"))).alias("target"))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a table of one row per source if its row count is under the bound."""
    return F.broadcast(df) if df.count() <= BROADCAST_SOURCES else df


def mix_thresholds(rows: DataFrame, weights: Sequence[float] = (5, 2, 1), budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``rows``: (source, size, h). One row per source: source, source_size, target, passes (whole passes over
    the source), threshold (of a further pass, rows with a smaller hash are taken), and for the rows whose hash
    is exactly ``threshold``: part, the share of each that is taken. A single row at the threshold is taken
    whole or left, whichever is nearer; rows with one and the same hash there share what is left."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    state = (
        source_targets(sizes, weights, budget, cap)
        .withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("left", F.col("target") - F.col("passes") * F.col("source_size"))
        .withColumn("prefix", F.lit(0).cast("long"))
        .withColumn("open", F.col("left") > 0)
        .withColumn("n", F.lit(None).cast("long"))
        .withColumn("atom", F.lit(None).cast("long"))
    )
    state = materialise(state, "mix-state")
    inside = rows.where(F.col("size") > 0)
    cumulative = Window.partitionBy("source").orderBy("bucket")
    for level in range(1, HASH_BITS // LEVEL_BITS + 1):
        shift, above = HASH_BITS - LEVEL_BITS * level, HASH_BITS - LEVEL_BITS * (level - 1)
        at = _small(state.where("open").select(F.col("source").alias("s"), F.col("prefix").alias("p")))
        inside = inside.join(at, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", above) == F.col("p"))).drop("s", "p")
        cells = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        cells = cells.withColumn("upto", F.sum("words").over(cumulative)).select(F.col("source").alias("s"), "bucket", "words", F.col("n").alias("cell_n"), "upto")
        hit = (
            cells.join(_small(state.where("open").select(F.col("source").alias("t"), F.col("left").alias("budget_left"))), F.col("s").eqNullSafe(F.col("t")))
            .where(F.col("upto") > F.col("budget_left"))
            .groupBy("s")
            .agg(F.min(F.struct("bucket", "words", "cell_n", "upto")).alias("cell"))
        )
        found = F.col("cell").isNotNull()
        state = (
            state.join(hit, F.col("source").eqNullSafe(F.col("s")), "left")
            .withColumn("left", F.when(found, F.col("left") - (F.col("cell.upto") - F.col("cell.words"))).otherwise(F.col("left")))
            .withColumn("n", F.when(found, F.col("cell.cell_n")).otherwise(F.col("n")))
            .withColumn("atom", F.when(found, F.col("cell.words")).otherwise(F.col("atom")))
            .withColumn("prefix", F.when(found, F.col("cell.bucket")).when(F.col("open"), F.lit(1 << 62)).otherwise(F.shiftleft("prefix", LEVEL_BITS)))
            .withColumn("open", F.col("open") & found)
            .drop("s", "cell")
        )
        state = materialise(state, "mix-state")
        if state.where(F.col("open") & (F.col("n") > 1)).isEmpty():
            break
    # A closed source either has no budget left for a further pass or (never, as left < source_size) takes it whole.
    tail = HASH_BITS - LEVEL_BITS * level
    single = F.when(F.col("left") * 2 >= F.col("atom"), 1.0).otherwise(0.0)
    return state.select(
        "source",
        "source_size",
        "target",
        "passes",
        F.when(F.col("open"), F.shiftleft("prefix", tail)).otherwise(F.lit(0)).alias("threshold"),
        F.lit((1 << tail) - 1).cast("long").alias("width"),
        F.when(~F.col("open"), 0.0).when(F.col("n") == 1, single).otherwise(F.col("left") / F.col("atom")).alias("part"),
    )


def apply_mix(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Adds source_size, target and taken to rows that have source, size and h. Columns of these names in
    ``rows`` are replaced."""
    t = _small(thresholds.withColumnRenamed("source", "__s"))
    rows = rows.drop("source_size", "target", "taken", "passes", "threshold", "width", "part", "__s")
    atom = F.floor(F.col("size") * F.col("part")).cast("long")
    further = F.when(F.col("h") < F.col("threshold"), F.col("size")).when(F.col("h") <= F.col("threshold") + F.col("width"), atom).otherwise(0)
    return (
        rows.join(t, F.col("source").eqNullSafe(F.col("__s")))
        .withColumn("taken", (F.col("passes") * F.col("size") + further).cast("long"))
        .drop("__s", "passes", "threshold", "width", "part")
    )


def row_hash(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The hash that decides on a row: of its id and its text, so that null or repeated ids don't fall together."""
    return hash60(F.col(doc_id), F.col(text))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Documents with size, source_size, target and taken, all other columns as they were.

    A null or empty text has size 0 and nothing of it is taken. A null source is a source of its own. Rows that
    agree in id and text have one hash: they are taken alike. An empty table gives an empty result."""
    rows = docs.withColumn("size", word_count(F.col("text"))).withColumn("h", row_hash())
    narrow = materialise(rows.select("source", "size", "h"), "mix-rows")
    return apply_mix(rows, mix_thresholds(narrow, weights, budget, cap)).drop("h")


def deal_copies(mixed: DataFrame) -> DataFrame:
    """Adds ``copies`` to the rows of ``mix``: how often each is taken whole. Only rows that are repeated as they are
    have a part of themselves to take; of these each task takes as many whole ones as their parts make, up to less
    than one for each different row. A column of this name is replaced; rows of size 0 are never taken."""
    mixed = mixed.drop("copies")
    at = mixed.withColumn("__h", row_hash())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: Counter[int] = Counter()
        task = TaskContext.get().partitionId()
        for b in batches:
            columns = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("taken", "size", "__h")]
            copies = []
            for taken, size, h in zip(*columns):
                whole, part = divmod(taken, size) if size else (0, 0)
                if part:
                    # Where a task begins within a copy differs by task, so that they don't all round alike.
                    start = (h + task * 0x9E3779B97F4A7C15) % size
                    before = (start + given[h] * part) // size
                    given[h] += 1
                    whole += (start + given[h] * part) // size - before
                copies.append(whole)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(copies, pa.int32())], names=[*b.schema.names[:-1], "copies"])

    return map_in_arrow(at, run, with_fields(mixed, copies=IntegerType()))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents; null texts and sources and repeated rows as in ``mix``."""
    docs = table(spark, sf_dir, "documents")
    rows = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_hash().alias("h")), "mix-rows")
    return apply_mix(rows, mix_thresholds(rows)).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'w', 'g'), '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, chr(0)) || chr(31) || coalesce(text, chr(0))), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s
), r AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio FROM w
), l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0)) AS level
  FROM r WINDOW b AS (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, ratio) FROM l WHERE ratio >= level) * weight, cap)) AS target FROM l
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM t
), c AS (
  SELECT d.*, p.source_size, p.target, p.passes, p.target - p.passes * p.source_size AS room,
         sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(size) OVER (PARTITION BY d.source, h) AS atom, sum((size > 0)::INT) OVER (PARTITION BY d.source, h) AS n
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
       (passes * size + CASE WHEN room <= 0 THEN 0 WHEN upto <= room THEN size WHEN upto - atom > room THEN 0
          WHEN n = 1 THEN CASE WHEN (room - (upto - atom)) * 2 >= atom THEN size ELSE 0 END
          ELSE floor(size * ((room - (upto - atom)) / atom))::BIGINT END)::BIGINT AS taken
FROM c
"""
