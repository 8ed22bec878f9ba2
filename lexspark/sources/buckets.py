"""Objects by id in buckets: a merge rewrites the buckets that its ids fall into and leaves the files of the others.

A version is a manifest that names the folder of every bucket. Merges write new folders and then make the next manifest,
which only one writer can; the one that comes second merges again into what the first has left. Readers of a version are
never disturbed, until ``vacuum`` deletes what the versions that stay don't name.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexspark.session import Scratch, delete_path, make_once


@dataclass(frozen=True)
class Manifest:
    """Number of a version, its number of buckets, its columns and the folder of each bucket that has rows."""

    number: int
    buckets: int
    schema: dict | None = None
    folders: dict[str, str] = field(default_factory=dict)


class BucketTable:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, slices: int = 4):
        """``buckets`` counts for a new table; one that is there keeps its own. A bucket is written by ``slices`` tasks."""
        self.spark, self.path, self.buckets, self.slices = spark, path.rstrip("/"), buckets, slices

    def _hadoop(self, path: str) -> tuple:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, p = self._hadoop(f"{self.path}/manifests")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def manifest(self, version: int | None = None) -> Manifest:
        """A version, or the last one; before the first merge an empty one."""
        v = self.versions()
        if not v:
            return Manifest(0, self.buckets)
        rows = self.spark.read.text(f"{self.path}/manifests/{version or v[-1]}.json", wholetext=True)
        return Manifest(**json.loads(rows.first()[0]))

    def _frame(self, m: Manifest, folders: list[str]) -> DataFrame:
        schema = StructType.fromJson(m.schema)
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame | None:
        """All rows of a version; None before the first merge."""
        m = self.manifest(version)
        return None if m.schema is None else self._frame(m, sorted(m.folders.values()))

    def lookup(self, ids: DataFrame) -> DataFrame | None:
        """The rows that have one of the ``ids`` (a column id); only their buckets are read."""
        m = self.manifest()
        if m.schema is None:
            return None
        wanted = {str(r[0]) for r in ids.select(_bucket(m.buckets)).distinct().collect()}  # at most the buckets
        return self._frame(m, sorted(f for b, f in m.folders.items() if b in wanted)).join(ids.select("id").distinct(), "id", "left_semi")

    def merge(self, rows: DataFrame) -> int:
        """Takes in ``rows``, whose ids are unique and not null: they replace those with their ids. Their columns must
        be the table's. Returns the version that has them; without rows, the last one if there is one."""
        held = Scratch(self.spark)
        new = held.table(rows, "merge")
        try:
            touched = [r[0] for r in new.select(_bucket(self.manifest().buckets)).distinct().collect()]  # at most the buckets
            while True:
                m = self.manifest()
                if m.schema is not None and [(f.name, f.dataType) for f in StructType.fromJson(m.schema)] != [(f.name, f.dataType) for f in new.schema]:
                    raise ValueError(f"{self.path} has other columns")
                if not touched and m.schema is not None:
                    return m.number
                after = self._rewrite(m, new, touched)
                if self._commit(after):
                    return after.number
        finally:
            held.keep()

    def _rewrite(self, m: Manifest, new: DataFrame, touched: list[int]) -> Manifest:
        """Writes the ``touched`` buckets of ``m`` with the new rows, and says what the next version is."""
        old = [m.folders[str(b)] for b in touched if str(b) in m.folders]
        merged = self._frame(m, old).join(new.select("id"), "id", "left_anti").select(*new.columns).unionByName(new) if old else new
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        if touched:
            dealt = merged.withColumn("__bucket", _bucket(m.buckets)).withColumn("__slice", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(self.slices)))
            dealt.repartition("__bucket", "__slice").sortWithinPartitions("__bucket", "id").drop("__slice").write.partitionBy("__bucket").parquet(folder)
        return Manifest(m.number + 1, m.buckets, json.loads(new.schema.json()), m.folders | {str(b): f"{folder}/__bucket={b}" for b in touched})

    def _commit(self, m: Manifest) -> bool:
        """Whether ``m`` has become the next version."""
        return make_once(self.spark, f"{self.path}/manifests/{m.number}.json", json.dumps(vars(m)).encode())

    def vacuum(self, keep: int = 5) -> None:
        """Deletes all versions but the last ``keep``, and the folders that only they name. No merge may run meanwhile."""
        gone, kept = self.versions()[:-keep], self.versions()[-keep:]
        live = {f for v in kept for f in self.manifest(v).folders.values()}
        for v in gone:
            for f in set(self.manifest(v).folders.values()) - live:
                delete_path(self.spark, f)
        for v in gone:
            delete_path(self.spark, f"{self.path}/manifests/{v}.json")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")
