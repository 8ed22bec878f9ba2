"""Sharding: a table of immutable Parquet shards under size-tiered compaction and versioned manifests.

Arrivals are appended as small shards. Shards that are smaller than the target fall into tiers by the power of the
fan-in that their size is; tiers with as many shards as the fan-in are merged into files of about the target size, along
with the tier that these files would fill.
Every change is one new manifest, put in place by a rename that fails if another writer was first: readers see the
version before or the one after, and a job that dies leaves files that no manifest names. Old versions stay readable
until ``vacuum`` is called; nothing else removes them.

The manifest lists files, not rows: at a target of 128 MB, 100 TB are 800,000 entries on the driver at the most.
"""

from __future__ import annotations

import json
import math
import uuid
from collections import defaultdict
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexspark.llm.common import table
from lexspark.session import delete_path, scratch_path

TARGET_BYTES, FAN_IN = 128 << 20, 8
#: Versions that a vacuum leaves by default.
KEEP_VERSIONS = 100
#: Arrivals that op1 makes of the documents.
ARRIVALS = 8


class CommitConflict(RuntimeError):
    """Another writer committed this version first."""


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    rows: int


class ShardStore:
    """A versioned table in the folder ``path``, which driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN):
        if fan_in < 2 or target_bytes < 1:
            raise ValueError("fan_in must be 2 at least, target_bytes 1")
        self.spark, self.path, self.target_bytes, self.fan_in = spark, path.rstrip("/"), target_bytes, fan_in
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # Files, by Hadoop's API: the folder may be in any store that Spark knows.

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _list(self, folder: str) -> list[tuple[str, int]]:
        p = self._path(folder)
        fs = p.getFileSystem(self._conf)
        if not fs.exists(p):
            return []
        return sorted((s.getPath().toString(), s.getLen()) for s in fs.listStatus(p) if s.isFile())

    def _read_text(self, path: str) -> str:
        p = self._path(path)
        stream = p.getFileSystem(self._conf).open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    # Manifests.

    def versions(self) -> list[int]:
        return [int(name.rpartition("/v")[2].removesuffix(".json")) for name, _ in self._list(f"{self.path}/manifest") if name.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, by default the last; version 0 is the empty table."""
        at = max(self.versions(), default=0) if version is None else version
        if at == 0:
            return {"version": 0, "schema": None, "shards": []}
        return json.loads(self._read_text(f"{self.path}/manifest/v{at:010d}.json"))

    def shards(self, version: int | None = None) -> list[Shard]:
        return [Shard(**s) for s in self.manifest(version)["shards"]]

    def _commit(self, base: dict, schema: dict | None, shards: list[Shard]) -> int:
        version = base["version"] + 1
        body = json.dumps({"version": version, "schema": schema, "shards": [asdict(s) for s in shards]})
        tmp, final = self._path(f"{self.path}/manifest/.{uuid.uuid4().hex}"), self._path(f"{self.path}/manifest/v{version:010d}.json")
        fs = tmp.getFileSystem(self._conf)
        out = fs.create(tmp, False)
        out.write(bytearray(body.encode()))
        out.close()
        if fs.exists(final):
            fs.delete(tmp, False)
            raise CommitConflict(f"version {version} of {self.path} exists")
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri() if final.isAbsolute() and final.toUri().getScheme() else fs.getUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(tmp, final, options)  # without the option to overwrite
        except Exception as e:
            fs.delete(tmp, False)
            if "FileAlreadyExists" in str(e):
                raise CommitConflict(f"version {version} of {self.path} exists") from e
            raise
        return version

    # Changes.

    def _written(self, folder: str, schema: StructType) -> list[Shard]:
        """The shards of a folder that a job has written; files without rows are left out."""
        sizes = [(p, n) for p, n in self._list(folder) if p.endswith(".parquet")]
        if not sizes:
            return []
        name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
        rows = {r[0]: r[1] for r in self.spark.read.schema(schema).parquet(folder).groupBy(name).count().collect()}
        return [Shard(p, n, rows[f]) for p, n in sizes if rows.get(f := p.rpartition("/")[2])]

    def append(self, df: DataFrame, arrival: str | None = None, compact: bool = True) -> int:
        """Add rows as new shards; with ``arrival``, every value of that column is an arrival of its own: the
        shards of all are written in one pass, and each is committed and compacted after the one before.
        The column itself is not stored. A schema that differs from the table's is refused. Returns the version."""
        base = f"{self.path}/data/{uuid.uuid4().hex}"
        if arrival is None:
            folders, schema = [base], df.schema
            df.write.parquet(base)
        else:
            schema = StructType([f for f in df.schema.fields if f.name != arrival])
            df.write.partitionBy(arrival).parquet(base)
            p = self._path(base)
            folders = sorted(s.getPath().toString() for s in p.getFileSystem(self._conf).listStatus(p) if s.isDirectory())
        known = self.manifest()["schema"]
        if known is not None and [(f["name"], f["type"]) for f in known["fields"]] != [(f["name"], f["type"]) for f in schema.jsonValue()["fields"]]:
            delete_path(self.spark, base)
            raise ValueError("the rows' schema differs from the table's")
        version = self.manifest()["version"]
        for folder in folders or [base]:
            now = self.manifest()
            version = self._commit(now, schema.jsonValue(), [Shard(**s) for s in now["shards"]] + self._written(folder, schema))
            if compact:
                version = self.compact()
        return version

    def tier(self, shard: Shard) -> int:
        return max(0, math.floor(math.log(max(shard.bytes, 1), self.fan_in)))

    def _files(self, runs: list[Shard]) -> int:
        """How many files a merge of these shards writes."""
        return max(1, round(sum(s.bytes for s in runs) / self.target_bytes))

    def _full(self, tiers: dict[int, list[Shard]]) -> list[Shard]:
        """The shards of all tiers that have as many as the fan-in, and of those that a merge of these would fill: as
        one merge, no row is written twice on its way up."""
        taken = {t for t, runs in tiers.items() if len(runs) >= self.fan_in}
        while True:
            runs = [s for t in sorted(taken) for s in tiers[t]]
            if not runs:
                return runs
            files = self._files(runs)
            size = sum(s.bytes for s in runs) // files
            to = self.tier(Shard("", size, 0))
            if size >= self.target_bytes * 3 // 4 or to in taken or len(tiers.get(to, [])) + files < self.fan_in:
                return runs
            taken.add(to)

    def compact(self) -> int:
        """Merge tiers until none below the target has as many shards as the fan-in. Each merge is a commit.
        A task reads its share of the tier's files and writes one file: no shuffle, no sort."""
        while True:
            now = self.manifest()
            shards = [Shard(**s) for s in now["shards"]]
            tiers: dict[int, list[Shard]] = defaultdict(list)
            for s in shards:
                if s.bytes < self.target_bytes * 3 // 4:
                    tiers[self.tier(s)].append(s)
            runs = self._full(tiers)
            if not runs:
                return now["version"]
            schema, files = StructType.fromJson(now["schema"]), self._files(runs)
            folder = f"{self.path}/data/{uuid.uuid4().hex}"
            self.spark.read.schema(schema).parquet(*[s.path for s in runs]).coalesce(files).write.parquet(folder)
            merged, old = self._written(folder, schema), {s.path for s in runs}
            if sum(s.rows for s in merged) != sum(s.rows for s in runs):
                raise RuntimeError("a merge lost rows; nothing was committed")
            self._commit(now, now["schema"], [s for s in shards if s.path not in old] + merged)

    def vacuum(self, keep: int = KEEP_VERSIONS) -> None:
        """Drop all versions but the last ``keep``, and the files that only they name. Readers of a dropped version
        lose its files, so ``keep`` is to cover the commits made during the longest read."""
        if keep < 1:
            raise ValueError("keep must be 1 at least")
        versions = sorted(self.versions())
        gone, stay = versions[:-keep], versions[-keep:]
        live = {s.path for v in stay for s in self.shards(v)}
        for v in gone:
            for s in self.shards(v):
                if s.path not in live:
                    delete_path(self.spark, s.path)
            delete_path(self.spark, f"{self.path}/manifest/v{v:010d}.json")

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        if m["schema"] is None:
            raise ValueError("nothing was ever appended")
        schema = StructType.fromJson(m["schema"])
        paths = [s["path"] for s in m["shards"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appends the documents in ARRIVALS arrivals and returns what the last version holds, texts as MD5.

    Rows come back as they went in: nulls, empty and very long texts, repeated rows and all columns."""
    docs = table(spark, sf_dir, "documents")
    store = ShardStore(spark, scratch_path(spark, "shards"))
    store.append(docs.withColumn("__arrival", F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS))), arrival="__arrival")
    return store.read().select("doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5"))


OP1_SQL = "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents"
