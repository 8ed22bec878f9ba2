"""An inverted-list index of vectors for cosine similarity.

Every vector stands in the list of its nearest centroid, in blocks of bounded size, and lists are folders that a search
prunes to those it probes. A probe multiplies a block of queries with a block of vectors. Probing further lists by
their angles makes an answer exact: a list is left out only if nothing in it can reach the kth score.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.operators.retrieve import top_k
from lexspark.session import Scratch, map_in_arrow

#: The bound of what centroids are trained on, and rounds of training.
SAMPLE_VECTORS, TRAIN_ROUNDS = 16_384, 8
#: Lists travel to every task as centroids, so their number has a bound.
MAX_LISTS = 4_096
#: Vectors of a block of a list, and queries that meet it together.
BLOCK_VECTORS, BLOCK_QUERIES = 2_048, 512
#: Bytes of scores that a step of training or assigning holds at a time.
STEP_BYTES = 1 << 24
#: Scores count to so many digits; ties go to the smaller id.
DIGITS = 6


@dataclass(frozen=True)
class VectorIndex:
    """``lists``: (list, n, least): how many vectors a list has, and the least cosine between one and its centroid."""

    spark: SparkSession
    path: str
    centroids: np.ndarray
    least: np.ndarray

    def blocks(self) -> DataFrame:
        return self.spark.read.schema("ids array<bigint>, matrix array<double>, list int").parquet(f"{self.path}/blocks")


def unit(v: Column) -> Column:
    """The vector as doubles of length one; a vector of zeros stays."""
    d = F.transform(v, lambda x: x.cast("double"))
    size = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    return F.element_at(F.transform(F.array(F.struct(d.alias("d"), size.alias("n"))), lambda p: F.transform(p["d"], lambda x: F.when(p["n"] > 0, x / p["n"]).otherwise(0.0))), 1)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _slices(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from (b.slice(at, step) for at in range(0, b.num_rows, step))


def _step(lists: int) -> int:
    """Rows to compare at a time with so many lists."""
    return max(1, STEP_BYTES // (8 * lists))


def _sample(rows: DataFrame, n: int) -> np.ndarray:
    """The vectors of the ``SAMPLE_VECTORS`` rows of ``n`` with the smallest hashes of their ids, in order. Tasks cut
    them down, so that these are all that the driver gets."""
    hashed = rows.withColumn("h", F.xxhash64("doc_id"))

    def least(some: DataFrame) -> pa.Array:
        return some.orderBy("h", "doc_id", "v").limit(SAMPLE_VECTORS).select("v").toArrow().column("v").combine_chunks()

    # Twice as many have hashes below this, unless ids repeat.
    found = least(hashed.where(F.col("h") < 2**65 * SAMPLE_VECTORS // n - 2**63)) if n > 4 * SAMPLE_VECTORS else None
    if found is None or len(found) < SAMPLE_VECTORS:
        found = least(hashed)
    lengths = np.unique(found.value_lengths())
    if len(lengths) > 1:
        raise ValueError(f"vectors of different lengths: {lengths.tolist()}")
    return _matrix(found, int(lengths[0]))


def _train(x: np.ndarray, lists: int) -> np.ndarray:
    """Directions that the sample's vectors gather around: means of the nearest, made as long as one."""
    c = x[:: max(1, len(x) // lists)][:lists].copy()
    step = _step(len(c))
    for _ in range(TRAIN_ROUNDS):
        which = np.concatenate([(x[at : at + step] @ c.T).argmax(axis=1) for at in range(0, len(x), step)])
        sums = np.zeros_like(c)
        np.add.at(sums, which, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.where(size > 0, size, 1), c)
    return c


def build(vectors: DataFrame, path: str, doc_id: str = "doc_id", vector: str = "embedding", lists: int | None = None) -> VectorIndex:
    """Index every row of ``vectors`` under ``path``, which must be new. All vectors have one length and finite components.

    Centroids are trained on the ``SAMPLE_VECTORS`` rows with the smallest hashes of their ids; without ``lists`` there
    are about as many as the root of the number of rows. Lists may be of any size: they are cut into blocks by a hash."""
    spark, held = vectors.sparkSession, Scratch(vectors.sparkSession)
    rows = vectors.select(F.col(doc_id).cast("long").alias("doc_id"), unit(F.col(vector)).alias("v"))
    n = rows.count()
    k = max(1, min(MAX_LISTS, lists or math.isqrt(n)))
    centroids = _train(_sample(rows, n), k) if n else np.zeros((0, 0))
    shared = spark.sparkContext.broadcast(centroids)  # at most MAX_LISTS vectors

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in _slices(batches, _step(len(c))):
            near = _matrix(b.column(1), c.shape[1]) @ c.T
            which = near.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(which.astype(np.int32)), pa.array(near[np.arange(len(which)), which])], names=["doc_id", "v", "list", "near"])

    assigned = held.table(rows.mapInArrow(assign, "doc_id long, v array<double>, list int, near double"), "vector-lists")
    sizes = assigned.groupBy("list").agg(F.count("*").alias("n"), F.min("near").alias("least"))
    cut = assigned.join(F.broadcast(sizes.select("list", F.ceil(F.col("n") / BLOCK_VECTORS).alias("parts"))), "list")  # at most MAX_LISTS rows
    cut = cut.withColumn("block", F.pmod(F.xxhash64("doc_id", "v"), F.col("parts")))
    blocks = cut.groupBy("list", "block").agg(F.collect_list(F.struct("doc_id", "v")).alias("rows"))
    blocks.select("list", F.col("rows.doc_id").alias("ids"), F.flatten("rows.v").alias("matrix")).repartition("list").write.partitionBy("list").parquet(f"{path}/blocks")
    least = np.ones(len(centroids))
    for r in sizes.collect():
        least[r["list"]] = r["least"]
    meta = json.dumps({"centroids": centroids.tolist(), "least": least.tolist()})
    spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.text(f"{path}/lists")
    held.keep()
    return VectorIndex(spark, path, centroids, least)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    meta = json.loads(spark.read.option("wholetext", True).text(f"{path}/lists").first()[0])
    return VectorIndex(spark, path, np.array(meta["centroids"]), np.array(meta["least"]))


def _asked(index: VectorIndex, queries: DataFrame, probes: int | None, first: int = 0) -> DataFrame:
    """(list, query_ids, queries): the queries that probe a list, in blocks of at most ``BLOCK_QUERIES``. They probe the
    lists from place ``first`` on; with ``probes``, so many nearest ones, else all whose vectors may reach ``kth``, a
    column of the queries."""
    shared = index.spark.sparkContext.broadcast((index.centroids, index.least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, least = shared.value
        for b in _slices(batches, BLOCK_QUERIES):
            q = _matrix(b.column(b.schema.get_field_index("qv")), c.shape[1])
            near = np.clip(q @ c.T, -1, 1)
            order = np.argsort(-near, axis=1, kind="stable")
            place = np.empty_like(order)
            np.put_along_axis(place, order, np.arange(len(c))[None, :], axis=1)
            if probes is not None:
                take = (place >= first) & (place < first + probes)
            else:
                # Two vectors are no nearer than the angle between query and centroid less the list's widest.
                most = np.cos(np.maximum(0, np.arccos(near) - np.arccos(np.clip(least, -1, 1))))
                kth = b.column(b.schema.get_field_index("kth")).to_numpy(zero_copy_only=False)
                take = (place >= first) & (most >= kth[:, None] - 2 * 10.0**-DIGITS)
            for at in np.flatnonzero(take.any(axis=0)):
                row = np.flatnonzero(take[:, at])
                ids, vectors = b.column(0).take(pa.array(row)), pa.array(q[row].ravel())
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), *(pa.ListArray.from_arrays([0, len(x)], x) for x in (ids, vectors))], names=["list", "query_ids", "queries"])

    return queries.mapInArrow(run, "list int, query_ids array<bigint>, queries array<double>")


def _probe(index: VectorIndex, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, list): the ``k`` best of each query in each block of its lists. A query stands in
    ``asked`` once a list, which Spark's estimates don't see, so without the hint it broadcasts them all through the
    driver while the table of queries is small."""
    dims = index.centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                query_ids, q, ids, v = (b.column(i)[r].values.to_numpy(zero_copy_only=False) for i in range(1, 5))
                scores = np.round(q.reshape(-1, dims) @ v.reshape(-1, dims).T, DIGITS)
                by_id = np.argsort(ids, kind="stable")
                best = by_id[np.argsort(-scores[:, by_id], axis=1, kind="stable")[:, :k]]
                n = best.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, n)), pa.array(ids[best].ravel()), pa.array(np.take_along_axis(scores, best, axis=1).ravel()), pa.array(np.full(best.size, b.column(0)[r].as_py(), np.int32))], names=["query_id", "doc_id", "score", "list"])

    pairs = asked.hint("merge").join(index.blocks(), "list").select("list", "query_ids", "queries", "ids", "matrix")
    return map_in_arrow(pairs, run, "query_id long, doc_id long, score double, list int")


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int = 8, exact: bool = False, query_id: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
    """(query_id, doc_id, score, rank): the ``k`` vectors nearest to each query in its ``probes`` nearest lists, by
    cosine to ``DIGITS`` digits, ties to the smaller id. With ``exact``, all lists that may change the answer are
    probed after these, so that it equals a comparison with every vector. Ids of queries are unique."""
    return _search(index, queries, k, probes, exact, query_id, query_vector).drop("list")


def _search(index: VectorIndex, queries: DataFrame, k: int, probes: int, exact: bool, query_id: str, query_vector: str) -> DataFrame:
    if not len(index.centroids):
        return index.spark.createDataFrame([], "query_id long, doc_id long, score double, list int, rank int")
    held = Scratch(index.spark)
    q = held.table(queries.select(F.col(query_id).cast("long").alias("query_id"), unit(F.col(query_vector)).alias("qv")), "vector-queries")
    parts = max(1, -(-q.count() // BLOCK_QUERIES))
    best = top_k(_probe(index, _asked(index, q.repartition(parts), probes), k), k)
    if exact:
        first = held.table(best, "vector-first")
        kth = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
        open_ = q.join(kth, "query_id", "left").select("query_id", "qv", F.coalesce("kth", F.lit(-2.0)).alias("kth"))
        more = _probe(index, _asked(index, open_.repartition(parts), None, probes), k)
        best = top_k(first.drop("rank").unionByName(more), k)
    out = held.table(best, "vector-best")
    held.keep(out)
    return out


def probes_for(index: VectorIndex, k: int, target: float = 0.95, asked: int = 256) -> int:
    """How many lists hold this share of the ``k`` nearest vectors, measured with exact answers to at most ``asked``
    vectors of the index, those with the smallest hashes of their ids."""
    if not len(index.centroids):
        return 1
    rows = index.blocks().select(F.inline(F.arrays_zip("ids", F.transform(F.sequence(F.lit(0), F.size("ids") - 1), lambda i: F.slice("matrix", i * F.lit(index.centroids.shape[1]) + 1, F.lit(index.centroids.shape[1]))).alias("v"))))
    sample = rows.orderBy(F.xxhash64("ids"), "ids").limit(asked).select(F.monotonically_increasing_id().alias("query_id"), F.col("v").alias("query_vector"))
    held = Scratch(index.spark)
    sample = held.table(sample.coalesce(1), "vector-sample")
    vectors = {r["query_id"]: r["query_vector"] for r in sample.collect()}
    found = _search(index, sample, k, 1, True, "query_id", "query_vector").select("query_id", "list").collect()  # asked * k rows
    held.keep()
    near = np.array([vectors[r["query_id"]] for r in found]) @ index.centroids.T
    lists = np.array([r["list"] for r in found])
    place = (near > near[np.arange(len(lists)), lists][:, None]).sum(axis=1)
    return int(np.quantile(place, target, method="higher")) + 1


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row (n_queries, recall): the share of exact answers that were found, counting an answer with the score of an
    exact one as found."""
    kth = exact.groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n"))
    good = found.join(kth, "query_id").where(F.col("score") >= F.col("kth")).groupBy("query_id").agg(F.count("*").alias("got"))
    return kth.join(good, "query_id", "left").agg(F.count("*").alias("n_queries"), (F.sum(F.coalesce("got", F.lit(0))) / F.sum("n")).alias("recall"))
