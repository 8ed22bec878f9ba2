"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Rows are dealt into blocks of bounded size, and so are the queries; every pair of a query block and a row block is one
task. There, each dimension has a list of the block's rows in order of its component. A query reads all lists from
the end where they help its score most, further with every round; rows it meets are scored in full, once. The sum of
what the lists show at the depth it has reached bounds the score of every row it hasn't met: as soon as that is under
the k-th best score, the block is done. The blocks' results are merged by rank.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.llm.common import table
from lexspark.session import materialise

#: Rows and queries of one task.
BLOCK_ROWS, BLOCK_QUERIES = 8_192, 4_096


def _number_type(*bounds: float) -> type:
    """The fastest arithmetic that is exact for sums of this size."""
    most = max(bounds)
    return np.float64 if most < 2**53 else np.int64 if most < 2**63 else object


def _in_order(score: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Places by falling score and then by key."""
    if score.dtype != object:
        return np.lexsort((key, -score))
    return np.array(sorted(range(len(score)), key=lambda i: (-score[i], key[i])), np.int64)


def _beyond(score: int) -> str:
    """Text that orders scores beyond 64 bits; one text for all others. A score has at most a few hundred digits."""
    digits = str(abs(score))
    if -(2**63) <= score < 2**63:
        return "1"
    if score > 0:
        return f"2{len(digits):05d}{digits}"
    return f"0{99_999 - len(digits):05d}" + digits.translate(str.maketrans("0123456789", "9876543210"))


def threshold_top_k(rows: np.ndarray, lists: np.ndarray, query: np.ndarray, k: int, order_key: np.ndarray, skip: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and scores of the ``k`` rows with the greatest inner product with ``query``, of ties those with the
    smaller ``order_key``; position ``skip`` takes no part. ``lists[:, d]``: positions in order of component d."""
    n = len(rows)
    dims = np.flatnonzero(query != 0)
    up = dims[query[dims] > 0]
    down = dims[query[dims] < 0]
    met = np.zeros(n, bool)
    if skip >= 0:
        met[skip] = True
    best_at, best = np.empty(0, np.int64), np.empty(0, rows.dtype)
    depth, step = 0, max(8, n // (8 * max(1, len(dims))))
    while depth < n:
        upto = min(n, depth + step)
        fresh = np.zeros(n, bool)
        fresh[lists[n - upto : n - depth, up].ravel()] = True
        fresh[lists[depth:upto, down].ravel()] = True
        if not len(dims):
            fresh[:] = True
            upto = n
        fresh &= ~met
        met |= fresh
        new = np.flatnonzero(fresh)
        best_at, best = np.concatenate([best_at, new]), np.concatenate([best, rows[new] @ query])
        if len(best) > k:
            if best.dtype != object:
                floor = np.partition(best, len(best) - k)[len(best) - k]
                keep = np.flatnonzero(best >= floor)  # all ties of the k-th
                best_at, best = best_at[keep], best[keep]
            chosen = _in_order(best, order_key[best_at])[:k]
            best_at, best = best_at[chosen], best[chosen]
        depth, step = upto, step * 2
        if depth < n and len(best) == k:
            bound = rows[lists[n - depth - 1, up], up] @ query[up] + rows[lists[depth, down], down] @ query[down]
            if bound < best[-1]:
                break
        if met.all():
            break
    chosen = _in_order(best, order_key[best_at])
    return best_at[chosen], best[chosen]


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query`` holds, the ``k`` other rows with the greatest
    inner product of floor(scale * component), all if there are fewer; ties go to the smaller id, null last.

    Vectors that are null, or hold a null or a number that isn't finite, also once it is scaled, take no part;
    vectors of different lengths are not compared. A score that is no 64-bit integer is returned as the nearest one;
    the order is that of the exact scores. Ids may repeat: a row with the query's id is a candidate unless it is the query
    itself, and each of several query rows with one id has a result of its own. An empty table gives no rows.
    Every query meets every row block, so tasks and rows sent grow with queries times rows over the block sizes."""
    usable = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < float("inf")))
    id_type = vectors.schema[vec_id].dataType
    # Null ids travel as a flag, so that pandas keeps the others' type.
    rows = vectors.select(F.coalesce(F.col(vec_id), F.lit("0").cast(id_type)).alias("vec_id"), F.col(vec_id).isNull().alias("no_id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = materialise(rows.where(usable).withColumn("uid", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "topk-rows")
    counts = rows.agg(F.count("*").alias("n"), F.sum(F.col("q").cast("long")).alias("q")).first()
    row_blocks, query_blocks = max(1, -(-counts["n"] // BLOCK_ROWS)), max(1, -(-(counts["q"] or 0) // BLOCK_QUERIES))
    block = lambda n: F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("dim", block(row_blocks).alias("rb"), every(query_blocks).alias("qb"), "uid", "no_id", "vec_id", "v")
    right = rows.where("q").select("dim", every(row_blocks).alias("rb"), block(query_blocks).alias("qb"), "uid", "no_id", "vec_id", "v")

    def run(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        names = ["query_uid", "query_no_id", "query_id", "uid", "no_id", "vec_id", "score", "beyond"]
        if candidates.empty or queries.empty:
            return pd.DataFrame(columns=names)
        candidates = candidates.sort_values(["no_id", "vec_id", "uid"], ignore_index=True)
        whole = lambda c: np.floor(scale * np.stack(c.to_list()).astype(np.float64))
        a, b = whole(candidates["v"]), whole(queries["v"])
        with np.errstate(over="ignore"):
            kind = _number_type(max(1.0, np.abs(a).max(initial=0)) * max(1.0, np.abs(b).max(initial=0)) * max(1, a.shape[1]))
        if kind is object:
            a, b = (np.array([[int(x) for x in r] for r in m], dtype=object).reshape(m.shape) for m in (a, b))
        else:
            a, b = a.astype(kind), b.astype(kind)
        lists = np.argsort(a, axis=0, kind="stable").astype(np.int32)
        key, place = np.arange(len(a)), {u: i for i, u in enumerate(candidates["uid"])}
        out: list[pd.DataFrame] = []
        ids = {c: candidates[c].to_numpy() for c in ("uid", "no_id", "vec_id")}
        for q, uid, none, qid in zip(b, queries["uid"], queries["no_id"], queries["vec_id"]):
            at, score = threshold_top_k(a, lists, q, k, key, place.get(uid, -1))
            near = np.clip(score, -(2**63), 2**63 - 1).astype(np.int64) if kind is object else score.astype(np.int64)
            out.append(pd.DataFrame({"query_uid": uid, "query_no_id": none, "query_id": qid, **{c: x[at] for c, x in ids.items()}, "score": near, "beyond": [_beyond(int(x)) for x in score] if kind is object else "1"}))
        return pd.concat(out)

    keys = ["dim", "rb", "qb"]
    kind = id_type.simpleString()
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, f"query_uid long, query_no_id boolean, query_id {kind}, uid long, no_id boolean, vec_id {kind}, score long, beyond string")
    rank = F.row_number().over(Window.partitionBy("query_uid").orderBy(F.col("score").desc(), F.col("beyond").desc(), "no_id", "vec_id", "uid"))
    given = lambda flag, c: F.when(~F.col(flag), F.col(c)).alias(c)
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(given("query_no_id", "query_id"), "rank", given("no_id", "vec_id"), "score")


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all embeddings for every id divisible by 20; null and unusable vectors as in ``exact_top_k``."""
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(20)) == 0)


OP8_SQL = r"""
WITH e AS (
  SELECT row_number() OVER () AS u, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.u, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 20 = 0 AND c.u <> q.u AND len(c.v) = len(q.v)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY u ORDER BY score DESC, vec_id NULLS LAST)::INT AS rank FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
