"""Sinks: page logs, row files, versioned caches, JSON answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.session import Scratch, delete_path, make_once
from lexspark.sources.files import ROW_COLUMNS


def _claim(spark: SparkSession, path: str) -> int:
    """The number of a new commit: one more than the last. A number is taken by making its file, which only one writer
    can, so that no clock and no time of a file matters."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_commits")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    number = max((int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()), default=0) + 1
    while not make_once(spark, f"{path.rstrip('/')}/_commits/{number}"):
        number += 1
    return number


def append_log(df: DataFrame, path: str) -> None:
    """Records as JSON lines, each with the number of this commit and of its row: later commits come after earlier ones,
    and rows in the order of ``df``. Readers order by them whatever the files' times, sizes and names."""
    numbered = df.withColumn("commit", F.lit(_claim(df.sparkSession, path))).withColumn("row", F.monotonically_increasing_id())
    numbered.write.mode("append").option("ignoreNullFields", False).json(path)


def append_rows(df: DataFrame, path: str) -> None:
    """Rows as CSV with a header in every file; files that are there must have the same columns."""
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        have = spark.read.option("header", True).csv(path).columns
        if have and have != ROW_COLUMNS:
            raise ValueError(f"{path} has the columns {have}")
    df.select(*ROW_COLUMNS).write.mode("append").option("header", True).option("escape", '"').csv(path)


class AnswerJournal:
    """Answers as they come: each batch is a file of its own that is there as soon as its task ends, whatever becomes of
    the job. A rerun finds the ids that have an answer."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, answers: DataFrame) -> None:
        """One file for each partition, committed with its task and not with the job."""
        answers.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(self.path)

    def read(self, schema: str) -> DataFrame:
        """Of each id one answer: should a task have been lost after its file was there, the one in the first file."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(self.path)
        names = [c for c in rows.columns if c != "id"]
        return rows.select("*", F.col("_metadata.file_path").alias("__file")).groupBy("id").agg(F.min_by(F.struct(*names), "__file").alias("r")).select("id", "r.*")


class CacheStore:
    """A keyed cache as versions v1, v2, ... under a folder; the last is current, those before are its history."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        done = [n for n in names if n.startswith("v") and fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n[1:]) for n in done)

    def read(self, version: int | None = None) -> DataFrame | None:
        v = self.versions()
        return self.spark.read.parquet(f"{self.path}/v{version or v[-1]}") if v else None

    def write(self, cache: DataFrame) -> int:
        """A new version, unless the cache is what the last one holds. Returns the current version. The cache is
        worked out once, before it is compared and sorted."""
        v, held = self.versions(), Scratch(self.spark)
        cache = held.table(cache, "cache")
        try:
            if v:
                old = self.read()
                if old.schema == cache.schema and old.exceptAll(cache).isEmpty() and cache.exceptAll(old).isEmpty():
                    return v[-1]
            new = self.next_version()
            cache.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{self.path}/v{new}")
            return new
        finally:
            held.keep()

    def next_version(self) -> int:
        v = self.versions()
        return (v[-1] if v else 0) + 1

    def journal(self) -> AnswerJournal:
        """Where answers are kept until the next version has them."""
        return AnswerJournal(self.spark, f"{self.path}/journal/v{self.next_version()}")

    def answered(self) -> DataFrame:
        """(id, version): one row for every answer of all journals, under the version that took it in."""
        at = F.regexp_extract(F.col("_metadata.file_path"), r"/journal/v(\d+)/", 1).cast("int")
        return self.spark.read.schema("id string").option("recursiveFileLookup", True).parquet(f"{self.path}/journal").select("id", at.alias("version"))

    def prune(self, keep: int = 5) -> None:
        for v in self.versions()[:-keep]:
            delete_path(self.spark, f"{self.path}/v{v}")


def compact_json(df: DataFrame, name: str = "json") -> DataFrame:
    """All columns as one JSON text per row, nulls kept, no escaping beyond JSON's own."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(name))
