"""Centroid clustering in integers, filtered by ball trees.

Every task puts its vectors into metric trees: a ball holds its radius, its number of vectors and their sum. In a round
a ball that by the triangle inequality lies nearer to one centroid than to all others is assigned as a whole, by its
count and sum; others are opened, down to leaves, whose vectors are compared exactly. Trees are written once and read
in every round; only a count and a sum for each centroid are shuffled, and the driver holds the centroids alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm.common import map_in_arrow, table
from lexspark.session import Scratch

#: Vectors of one tree, which is a row of its table, and of a leaf.
TREE_VECTORS, LEAF_VECTORS = 4_096, 16
#: Centroids travel to every task, so their number has a bound.
MAX_CENTROIDS = 4_096
#: Distances from centroids that a task holds at a time.
CHUNK_DISTANCES = 1 << 20
#: Bounds are reckoned in floating point: a ball is assigned as a whole only if they differ by more than this share of
#: the vectors' lengths, ten times the square root of what a squared distance may be off by.
SLACK = 1e-6


def quantised(vector: Column, dims: int, scale: int) -> Column:
    """floor(scale * x) of every component as longs; null for a vector of another length or with a component that is
    null or not finite. A component so large that squared distances might not fit a long (2**27 with 64 components)
    raises an error."""
    most = math.isqrt((1 << 62) // dims) // 2
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    usable = (F.size(vector) == dims) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    far = F.exists(vector, lambda x: F.abs(x.cast("double") * F.lit(float(scale))) >= F.lit(float(most)))
    return F.when(F.coalesce(usable, F.lit(False)), F.when(far, F.raise_error(F.lit(f"a component of {most} or more after scaling"))).otherwise(scaled))


@dataclass
class _Tree:
    """Vectors in the order of their leaves, and balls as rows: a ball holds the vectors from ``first`` to ``last``."""

    vectors: np.ndarray
    order: np.ndarray
    balls: np.ndarray  # first, last, children (or -1), by level
    sums: np.ndarray
    radius: np.ndarray


def _build(x: np.ndarray) -> _Tree:
    """Balls are halved along the line between two vectors far from each other, until few vectors or only equal ones
    are left."""
    order = np.arange(len(x))
    balls, sums, radius = [[0, len(x), -1, -1]], [], []
    k = 0
    while k < len(balls):
        first, last, _, _ = balls[k]
        own = x[order[first:last]]
        total = own.sum(axis=0)
        centre = total / (last - first)
        away = np.sqrt(((own - centre) ** 2).sum(axis=1))
        sums.append(total)
        radius.append(float(away.max()) if (own != own[0]).any() else 0.0)
        if radius[-1] > 0 and last - first > LEAF_VECTORS:
            one = own[int(away.argmax())]
            from_one = ((own - one) ** 2).sum(axis=1)
            other = own[int(from_one.argmax())]
            from_other = ((own - other) ** 2).sum(axis=1)
            # Equal vectors stay together; both sides have some, as the two differ.
            near = from_one <= from_other
            order[first:last] = np.concatenate([order[first:last][near], order[first:last][~near]])
            middle = first + int(near.sum())
            balls[k][2:] = [len(balls), len(balls) + 1]
            balls += [[first, middle, -1, -1], [middle, last, -1, -1]]
        k += 1
    return _Tree(x[order], order, np.array(balls, np.int64), np.array(sums, np.int64).reshape(len(balls), -1), np.array(radius))


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x from all rows of c. Products go through floating point where they are
    exact there."""
    exact = (int(np.abs(x).max(initial=0)) + int(np.abs(c).max(initial=0))) ** 2 * x.shape[1] < 1 << 51
    dots = (x.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64) if exact else x @ c.T
    return (x * x).sum(axis=1)[:, None] - 2 * dots + (c * c).sum(axis=1)[None, :]


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, of ties the first, and the squared distance from it."""
    which, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    step = max(1, CHUNK_DISTANCES // len(c))
    for k in range(0, len(x), step):
        d = _squares(x[k : k + step], c)
        which[k : k + step] = d.argmin(axis=1)
        distance[k : k + step] = d.min(axis=1)
    return which, distance


def _filtered(tree: _Tree, c: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """((ball, centroid) for balls assigned as a whole, leaves to be opened): level by level from the root."""
    whole, leaves = [], []
    front = np.zeros(1, np.int64)
    centres = tree.sums / (tree.balls[:, 1] - tree.balls[:, 0])[:, None]
    cf = c.astype(np.float64)
    while len(front):
        m, r = centres[front], tree.radius[front]
        d = np.sqrt(np.maximum(0, (m * m).sum(1)[:, None] - 2 * m @ cf.T + (cf * cf).sum(1)))
        best = d.argmin(axis=1)
        near = d[np.arange(len(front)), best]
        d[np.arange(len(front)), best] = np.inf
        # Nothing in the ball is farther from its centroid than near + r, or nearer to another than the next less r.
        slack = SLACK * (1 + np.sqrt((m * m).sum(1)) + np.sqrt((cf * cf).sum(1).max()))
        sure = near + 2 * r + slack < d.min(axis=1) if len(c) > 1 else np.ones(len(front), bool)
        whole += zip(front[sure].tolist(), best[sure].tolist())
        rest = front[~sure]
        inner = tree.balls[rest, 2] >= 0
        leaves.append(rest[~inner])
        front = tree.balls[rest[inner], 2:4].ravel()
    return whole, np.concatenate(leaves)


_TREE = "ids binary, nulls binary, vectors binary, balls binary, sums binary, radius binary"


def _trees(vectors: DataFrame, vec_id: str, dims: int) -> DataFrame:
    """One row a tree of up to ``TREE_VECTORS`` vectors of a task; the ids in the order of the leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, nulls, rows = [], [], []

        def tree() -> pa.RecordBatch:
            t = _build(np.concatenate(rows))
            parts = [np.concatenate(ids)[t.order], np.concatenate(nulls)[t.order], t.vectors, t.balls, t.sums, t.radius]
            return pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], names=[c.split()[0] for c in _TREE.split(", ")])

        for b in batches:
            column = b.column(b.schema.get_field_index(vec_id))
            v = b.column(b.schema.get_field_index("vector"))
            x = v.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
            of, missing = column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), column.is_null().to_numpy(zero_copy_only=False)
            for k in range(0, len(x), TREE_VECTORS):
                cut = slice(k, k + TREE_VECTORS)
                if sum(map(len, rows)) + len(x[cut]) > TREE_VECTORS:
                    yield tree()
                    ids, nulls, rows = [], [], []
                ids.append(of[cut]), nulls.append(missing[cut]), rows.append(x[cut])
        if rows:
            yield tree()

    return map_in_arrow(vectors, run, _TREE)


def _read(b: pa.RecordBatch, dims: int) -> Iterator[tuple[_Tree, np.ndarray, np.ndarray]]:
    for row in b.to_pylist():
        x = np.frombuffer(row["vectors"], np.int64).reshape(-1, dims)
        balls = np.frombuffer(row["balls"], np.int64).reshape(-1, 4)
        tree = _Tree(x, np.arange(len(x)), balls, np.frombuffer(row["sums"], np.int64).reshape(-1, dims), np.frombuffer(row["radius"], np.float64))
        yield tree, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["nulls"], bool)


def _totals(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, n, s0, s1, ...): how many vectors each centroid gets and their sum, added up in tasks first."""
    dims, held = centroids.shape[1], trees.sparkSession.sparkContext.broadcast(centroids)  # at most MAX_CENTROIDS vectors
    names = [f"s{k}" for k in range(dims)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        n, s = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64)
        for b in batches:
            for tree, _, _ in _read(b, dims):
                whole, leaves = _filtered(tree, c)
                if whole:
                    ball, which = np.array(whole).T
                    np.add.at(n, which, tree.balls[ball, 1] - tree.balls[ball, 0])
                    np.add.at(s, which, tree.sums[ball])
                if len(leaves):
                    x = np.concatenate([tree.vectors[first:last] for first, last in tree.balls[leaves, :2].tolist()])
                    which, _ = _nearest(x, c)
                    n += np.bincount(which, minlength=len(c))
                    np.add.at(s, which, x)
        got = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(got), pa.array(n[got]), *[pa.array(s[got, k]) for k in range(dims)]], names=["cluster", "n", *names])

    part = map_in_arrow(trees, run, "cluster long, n long, " + ", ".join(f"{x} long" for x in names))
    # Sums of many tasks may pass 64 bits.
    return part.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col(x).cast("decimal(38,0)")).alias(x) for x in names])


def _assigned(trees: DataFrame, centroids: np.ndarray, vec_id: str) -> DataFrame:
    """(vec_id, cluster, distance) of every vector. In a ball that is assigned as a whole only one distance is
    reckoned for each vector."""
    dims, held = centroids.shape[1], trees.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        for b in batches:
            for tree, ids, nulls in _read(b, dims):
                which, distance = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
                whole, leaves = _filtered(tree, c)
                for ball, k in whole:
                    first, last = tree.balls[ball, :2]
                    away = tree.vectors[first:last] - c[k]
                    which[first:last], distance[first:last] = k, (away * away).sum(axis=1)
                for first, last in tree.balls[leaves, :2].tolist():
                    which[first:last], distance[first:last] = _nearest(tree.vectors[first:last], c)
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=nulls), pa.array(which.astype(np.int32)), pa.array(distance)], names=[vec_id, "cluster", "distance"])

    return map_in_arrow(trees, run, f"`{vec_id}` long, cluster int, distance long")


def seeds(vectors: DataFrame, k: int, vec_id: str = "vec_id", salt: str = "2:") -> np.ndarray:
    """The ``k`` vectors whose ids have the smallest SHA-256, in that order; equal ids by their components."""
    key = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col(vec_id).cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.select(key.alias("key"), "vector").orderBy("key", "vector").limit(k).collect()
    return np.array([r["vector"] for r in rows], np.int64)


def cluster(vectors: DataFrame, k: int, rounds: int, vec_id: str = "vec_id", vector: str = "embedding", dims: int = 64, scale: int = 256, salt: str = "2:") -> tuple[DataFrame, np.ndarray]:
    """(assignment, centroids): (vec_id, cluster, distance) of every usable vector after ``rounds`` rounds, and the
    ``k`` last centroids, fewer where there are fewer vectors.

    Vectors become integers as in ``quantised``; those that don't, take no part. Rows that repeat an id or a vector
    count as often as they stand; a null id is kept. Distances are exact, ties go to the smaller number, and a centroid
    becomes the exact floor of its vectors' mean; one without vectors stays. An empty table has no rows and no
    centroids. The driver gets ``k`` (at most ``MAX_CENTROIDS``) sums a round."""
    if not 1 <= k <= MAX_CENTROIDS or not 1 <= dims <= 4_096:
        raise ValueError(f"{k} centroids of {dims} components; there may be {MAX_CENTROIDS} of 4096, as every task holds them")
    held = Scratch(vectors.sparkSession)
    rows = vectors.select(F.col(vec_id).cast("long").alias(vec_id), quantised(F.col(vector), dims, scale).alias("vector")).where(F.col("vector").isNotNull())
    trees = held.table(_trees(rows, vec_id, dims), "centroid-trees")
    centroids = seeds(rows, k, vec_id, salt)
    if not len(centroids):
        return held.table(_assigned(trees, np.zeros((1, dims), np.int64), vec_id), "centroid-assigned"), centroids.reshape(0, dims)
    for _ in range(rounds):
        moved = centroids.copy()
        for r in _totals(trees, centroids).collect():
            moved[r["cluster"]] = [int(r[f"s{d}"]) // r["n"] for d in range(dims)]
        if (moved == centroids).all():
            break
        centroids = moved
    out = held.table(_assigned(trees, centroids, vec_id), "centroid-assigned")
    held.keep(out)
    return out, centroids


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of ``embeddings``: 40 centroids, five rounds; the rest as in ``cluster``."""
    found, centroids = cluster(table(spark, sf_dir, "embeddings"), 40, 5)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    per = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    every = F.broadcast(found.agg(F.sum("distance").alias("inertia")))  # one row
    digest = F.element_at(F.array(*map(F.lit, digests or [""])), F.col("cluster") + 1)
    out = found.join(F.broadcast(per), "cluster").crossJoin(every)  # at most 40 rows, and one
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


_ROUNDS = 5


def _round(k: int) -> str:
    """Assignment to the centroids c{k} and the centroids after it."""
    return f"""a{k} AS MATERIALIZED (SELECT vec_id, rid, v, arg_min(c, (d, cluster)) AS c, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM
 (SELECT vec_id, rid, v, c, cluster, list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT AS d FROM kept, c{k}) GROUP BY vec_id, rid, v),
m{k} AS (SELECT cluster, list((CASE WHEN s >= 0 OR s % n = 0 THEN s // n ELSE -((-s + n - 1) // n) END)::BIGINT ORDER BY i) AS c FROM
 (SELECT cluster, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{k}, range(1, 65) AS r(i) GROUP BY cluster, i) GROUP BY cluster),
c{k + 1} AS MATERIALIZED (SELECT c{k}.cluster, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (cluster))"""


OP12_SQL = f"""WITH kept AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
 WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS cluster, v AS c FROM (SELECT sha256('2:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM kept ORDER BY h, v LIMIT 40)),
{", ".join(_round(k) for k in range(_ROUNDS + 1))}
SELECT vec_id, cluster::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{_ROUNDS}"""
