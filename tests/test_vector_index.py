"""The vector index against a comparison with every vector."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspark.operators import retrieve, vector_index


def unit(x):
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def nearest(ids, x, query_ids, q, k):
    s = np.round(unit(q) @ unit(x).T, 6)
    return {i: [(int(ids[j]), s[r, j]) for j in sorted(range(len(ids)), key=lambda j: (-s[r, j], ids[j]))[:k]] for r, i in enumerate(query_ids)}


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    return out


@pytest.fixture(scope="module")
def clustered():
    """Groups of directions, a third of all rows one vector, some zeros."""
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(12, 8))
    x = centre[rng.integers(0, 12, 600)] + rng.normal(scale=0.15, size=(600, 8))
    x[::3] = x[0]
    x[7] = 0
    return np.arange(600), x


def frame(spark, ids, x, a="doc_id", b="embedding"):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], f"{a} long, {b} array<double>").repartition(4)


@pytest.mark.parametrize("block", [2_048, 50])
def test_exact_answers_equal_a_plain_comparison(spark, tmp_path, monkeypatch, clustered, block):
    monkeypatch.setattr(vector_index, "BLOCK_VECTORS", block)
    monkeypatch.setattr(vector_index, "BLOCK_QUERIES", 16)
    ids, x = clustered
    built = vector_index.build(frame(spark, ids, x), f"file://{tmp_path}/index")
    q = np.concatenate([x[::15], np.random.default_rng(1).normal(size=(5, 8)), np.zeros((1, 8))])
    queries = frame(spark, range(len(q)), q, "query_id", "query_vector")
    want = nearest(ids, x, range(len(q)), q, 10)
    got = answers(vector_index.search(vector_index.open_index(spark, f"file://{tmp_path}/index"), queries, 10, probes=2, exact=True))
    assert {k: [(i, pytest.approx(s, abs=1e-6)) for i, s in v] for k, v in want.items()} == got
    assert built.blocks().select(F.sum(F.size("ids"))).first()[0] == 600


def test_few_lists_find_nearly_all_and_are_all_that_is_read(spark, tmp_path, clustered):
    ids, x = clustered
    built = vector_index.build(frame(spark, ids, x), f"file://{tmp_path}/index")
    queries = frame(spark, ids[::20], x[::20], "query_id", "query_vector")
    probes = vector_index.probes_for(built, 10)
    assert 1 <= probes < len(built.centroids)
    found, exact = (vector_index.search(built, queries, 10, probes=probes, exact=e) for e in (False, True))
    row = vector_index.recall(found, exact).first()
    assert row["n_queries"] == 30 and row["recall"] >= 0.9
    assert vector_index.recall(exact, exact).first()["recall"] == 1.0


def test_more_asked_than_there_is(spark, tmp_path):
    built = vector_index.build(frame(spark, [3, 1], np.eye(2)), f"file://{tmp_path}/two", lists=9)
    got = answers(vector_index.search(built, frame(spark, [0], np.array([[1.0, 1.0]]), "query_id", "query_vector"), 5, probes=1, exact=True))
    assert [i for i, _ in got[0]] == [1, 3]
    none = vector_index.build(frame(spark, [3], np.eye(2)[:1]).limit(0), f"file://{tmp_path}/none")
    assert vector_index.search(none, frame(spark, [0], np.eye(2)[:1], "query_id", "query_vector"), 5).collect() == []


def test_scores_of_all_pairs(spark, monkeypatch, clustered):
    """By batches and by the blocks of many queries; zeros have 0, null vectors none."""
    monkeypatch.setattr(retrieve, "MAX_PAIRS", 64)
    ids, x = clustered
    docs = frame(spark, ids[:90], x[:90]).union(spark.createDataFrame([(1000, None)], "doc_id long, embedding array<double>"))
    queries = frame(spark, ids[:7], x[:7], "query_id", "query_vector")
    want = unit(x[:7]) @ unit(x[:90]).T
    for most in (10_000, 3):
        got = retrieve.vector_scores(docs, queries, max_queries=most).collect()
        assert len(got) == 630 and all(abs(r["score"] - want[r["query_id"], r["doc_id"]]) < 1e-9 for r in got)
    assert retrieve.vector_scores(docs, queries.limit(0)).collect() == []


def test_repeated_queries_are_not_broadcast(spark, tmp_path, monkeypatch, clustered):
    """A table of queries is small, but every query stands once for each list that it probes."""
    ids, x = clustered
    built = vector_index.build(frame(spark, ids, x), f"file://{tmp_path}/index", lists=40)
    path, plans, table = f"file://{tmp_path}/queries", [], vector_index.Scratch.table
    frame(spark, ids[::5], x[::5], "query_id", "query_vector").write.parquet(path)

    def noted(self, df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return table(self, df, name)

    monkeypatch.setattr(vector_index.Scratch, "table", noted)
    assert vector_index.search(built, spark.read.parquet(path), 3, probes=40).count() == 120 * 3
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_pairs_reach_python_in_small_batches(spark, tmp_path, clustered):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    ids, x = clustered
    built = vector_index.build(frame(spark, ids, x), f"file://{tmp_path}/index", lists=4)
    assert vector_index.search(built, frame(spark, ids[::60], x[::60], "query_id", "query_vector"), 3, probes=4).count() == 30
    assert spark.conf.get(key).rstrip("b") == str(4 << 20)


@pytest.mark.parametrize("ids", [np.arange(600), np.arange(600) % 3, np.zeros(600, int)])
def test_sample_has_the_smallest_hashes(spark, monkeypatch, clustered, ids):
    """Cut down in the tasks, also where ids repeat; the driver collects no rows."""
    monkeypatch.setattr(vector_index, "SAMPLE_VECTORS", 32)
    rows = frame(spark, ids, clustered[1], b="v")
    want = np.array([r["v"] for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id", "v").limit(32).collect()])
    monkeypatch.setattr(type(rows), "collect", None)
    assert np.array_equal(vector_index._sample(rows, 600), want)


def test_vectors_of_different_lengths_are_an_error(spark, tmp_path):
    mixed = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, [1.0, 2.0, 3.0])], "doc_id long, embedding array<double>")
    with pytest.raises(ValueError):
        vector_index.build(mixed, f"file://{tmp_path}/mixed")


def test_training_holds_few_scores_at_a_time(monkeypatch):
    x = unit(np.random.default_rng(2).normal(size=(4_096, 8)))
    tracemalloc.start()
    whole = vector_index._train(x, 2_000)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 8 * 4_096 * 2_000 / 2
    monkeypatch.setattr(vector_index, "STEP_BYTES", 8 * 2_000 * 7)
    assert np.allclose(vector_index._train(x, 2_000), whole)


def test_every_query_asks_its_lists_once_in_small_blocks(spark, tmp_path, monkeypatch, clustered):
    monkeypatch.setattr(vector_index, "STEP_BYTES", 8 * 40 * 3)
    monkeypatch.setattr(vector_index, "BLOCK_QUERIES", 16)
    ids, x = clustered
    built = vector_index.build(frame(spark, ids, x), f"file://{tmp_path}/index", lists=40)
    n = len(built.centroids)
    asked = vector_index._asked(built, frame(spark, ids[::5], unit(x[::5]), "query_id", "qv").coalesce(1), n).collect()
    assert max(len(r["query_ids"]) for r in asked) <= 16 and all(len(r["queries"]) == 8 * len(r["query_ids"]) for r in asked)
    assert sorted((r["list"], i) for r in asked for i in r["query_ids"]) == [(at, i) for at in range(n) for i in ids[::5]]
    assert all(np.array_equal(np.reshape(r["queries"], (-1, 8)), unit(x)[r["query_ids"]]) for r in asked)
