"""Incremental extraction: page rows arrive as a stream, each batch inherits from the headings of the batches before.

A batch run over all pages and a stream over the same pages in order give the same rows. Pages of one file must arrive
in page order across micro-batches; within one they are ordered by the windows of ``inherit``.

The headings that batches leave are runs, merged by tiers: when ``FAN`` runs of a size are complete they become one of
the next size that has each heading once. So a batch reads at most ``FAN`` - 1 runs of each size, and a heading is
rewritten once a tier, however many batches there have been.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.operators.hierarchy import STRUCTURED, headings_of, inherit
from lexspark.session import delete_path

ROWS = "pdf string, page int, pos int, code string, description string"
OUTPUT = "pdf string, page int, pos int, code string, raw_description string, description string"
CONTEXT = "pdf string, digits string, description string, batch long"


#: Runs of headings that are merged into one.
FAN = 8


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _run(sink: str, first: int, size: int) -> str:
    """The folder of the headings that ``size`` batches from ``first`` on have left."""
    return f"{sink}/headings/size={size}/first={first}"


def runs_before(spark: SparkSession, sink: str, batch: int) -> list[str]:
    """The runs that together hold the headings of all batches before ``batch``, the largest that are there."""

    def within(first: int, size: int) -> list[str]:
        if _exists(spark, f"{_run(sink, first, size)}/_SUCCESS"):
            return [_run(sink, first, size)]
        return [r for at in range(first, first + size, size // FAN) for r in within(at, size // FAN)] if size > 1 else []

    size, first, found = 1, 0, []
    while size * FAN <= batch:
        size *= FAN
    while size:
        for _ in range((batch - first) // size):
            found += within(first, size)
            first += size
        size //= FAN
    return found


def _last(headings: DataFrame) -> DataFrame:
    """Of each heading what the last batch says."""
    return headings.groupBy("pdf", "digits").agg(F.max(F.struct("batch", "description")).alias("h")).select("pdf", "digits", "h.description", "h.batch")


def _merge(spark: SparkSession, sink: str, batch: int) -> None:
    """Merges the runs that ``batch`` completes. Those merged stay until the next batch has come, as ``batch`` may run
    again and must not see what it has left itself."""
    size = FAN
    while (batch + 1) % size == 0:
        first, small = batch + 1 - size, size // FAN
        runs = [r for at in range(first, batch + 1, small) if _exists(spark, r := _run(sink, at, small))]
        _last(spark.read.schema(CONTEXT).parquet(*runs)).sortWithinPartitions("pdf", "digits").write.mode("overwrite").parquet(_run(sink, first, size))
        size *= FAN


def _forget(spark: SparkSession, sink: str, batch: int) -> None:
    """Deletes runs that were merged before ``batch``."""
    size = FAN
    while batch and batch % size == 0:
        if _exists(spark, f"{_run(sink, batch - size, size)}/_SUCCESS"):
            for at in range(batch - size, batch, size // FAN):
                delete_path(spark, _run(sink, at, size // FAN))
        size *= FAN


def inherit_batch(rows: DataFrame, batch: int, sink: str, flavour: str = STRUCTURED) -> None:
    """Writes the rows of one batch under ``sink``, and the headings that they leave. The last batch may run again, as
    after a failure: it replaces what it has written and doesn't see it. Numbers that were never run are passed over."""
    spark = rows.sparkSession
    _forget(spark, sink, batch)
    known, runs = None, runs_before(spark, sink, batch)
    if runs:
        # Only the files of this batch; no bound holds for their number.
        known = _last(spark.read.schema(CONTEXT).parquet(*runs).join(rows.select("pdf").distinct(), "pdf", "left_semi"))
    out = f"{sink}/rows/batch={batch}"
    inherit(rows, flavour, known=known).select("pdf", "page", "pos", "code", "raw_description", "description").write.mode("overwrite").parquet(out)
    left = headings_of(spark.read.schema(OUTPUT).parquet(out), flavour).withColumn("batch", F.lit(batch).cast("long"))
    left.sortWithinPartitions("pdf", "digits").write.mode("overwrite").parquet(_run(sink, batch, 1))
    _merge(spark, sink, batch)


def ingest(spark: SparkSession, source: str, sink: str, checkpoint: str, files_per_batch: int = 1, flavour: str = STRUCTURED) -> None:
    """Runs all row files (Parquet) that are new since the last run through ``inherit`` and adds them to ``sink``. The
    checkpoint remembers files: a page is processed once, however often this is called."""
    rows = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    stream = rows.writeStream.foreachBatch(lambda batch, number: inherit_batch(batch, number, sink, flavour))
    stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_rows(spark: SparkSession, sink: str) -> DataFrame:
    """All rows that ``ingest`` has written."""
    return spark.read.schema(OUTPUT).parquet(f"{sink}/rows")
