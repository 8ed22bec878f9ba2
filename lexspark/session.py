"""Session helpers: where shared intermediate tables go, how they are written and when they go; batches for Python.

Executors and the driver share no local folders, so everything that outlives one job goes to the folder
named in ``spark.checkpoint.dir``. Only a session that runs in one process may leave it out.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Used only if the session names no folder and has no executors elsewhere.
DEFAULT_SHARED = "file:///tmp/checkpoints/lexspark"
#: Bytes of rows that a Python worker gets at a time, and Spark's own number, which this one replaces.
BATCH_BYTES, SPARKS_BATCH_BYTES = 4 << 20, 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held is not None and not held.startswith(DEFAULT_SHARED):
        return held.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if held is None:
        spark.sparkContext.setCheckpointDir(DEFAULT_SHARED)
    return DEFAULT_SHARED


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    return _written(df, scratch_path(df.sparkSession, name))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a file or folder on whatever file system its path names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def make_once(spark: SparkSession, path: str, content: bytes = b"") -> bool:
    """Make a file that must not be there yet: of several writers one succeeds. Hadoop's local file system only looks
    first, so there the operating system is asked."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p.getParent())
    if fs.getUri().getScheme() == "file":
        try:
            with open(fs.makeQualified(p).toUri().getPath(), "xb") as out:
                out.write(content)
        except FileExistsError:
            return False
        return True
    try:
        out = fs.create(p, False)
    except Py4JJavaError:
        if fs.exists(p):
            return False
        raise
    out.write(bytearray(content))
    out.close()
    return True


def map_in_arrow(df: DataFrame, run: Callable, schema: StructType | str) -> DataFrame:
    """``df.mapInArrow`` over batches of few bytes, as texts may be long and several tasks share an executor.

    Sets the session's limit, unless it has one that isn't Spark's own; longer rows still come whole. Workers outlive
    their tasks, so what Arrow holds in reserve is given back at the end of each."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key).rstrip("b") == str(SPARKS_BATCH_BYTES):
        df.sparkSession.conf.set(key, str(BATCH_BYTES))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(whole, schema)


class Scratch:
    """The intermediate tables of one operator. What a frame still to be run reads must outlive it, so the operator
    says when a table may go."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._held: list[tuple[DataFrame, str]] = []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """``materialise``, remembered."""
        path = scratch_path(self.spark, name)
        out = _written(df, path)
        self._held.append((out, path))
        return out

    def drop(self, *gone: DataFrame) -> None:
        """Delete these tables of ``table``."""
        for frame, path in self._held:
            if any(frame is g for g in gone):
                delete_path(self.spark, path)
        self._held = [(f, p) for f, p in self._held if not any(f is g for g in gone)]

    def keep(self, *needed: DataFrame) -> None:
        """Delete all tables but these."""
        self.drop(*[f for f, _ in self._held if not any(f is n for n in needed)])
