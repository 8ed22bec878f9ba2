"""The stored inverted index against BM25 over all texts."""

import random

import pytest
from pyspark.sql import functions as F

from lexspark.operators import retrieve, text_index


def made_up(n):
    """Texts over common and rare words; every tenth is one text, some are null or empty."""
    rng = random.Random(8)
    common, rare = [f"c{i}" for i in range(30)], [f"r{i}" for i in range(n // 4)]
    rows = [(i, " ".join(rng.choices(common, k=rng.randrange(3, 60)) + rng.choices(rare, k=2))) for i in range(n)]
    return [(i, "c1 c2 same text" if i % 10 == 0 else t) for i, t in rows] + [(n, None), (n + 1, "")]


@pytest.mark.parametrize("block", [4_096, 5])
def test_search_equals_all_documents(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(text_index, "BLOCK_POSTINGS", block)
    monkeypatch.setattr(text_index, "HEAD_POSTINGS", 8)
    docs = spark.createDataFrame(made_up(800), "doc_id long, text string").repartition(4)
    queries = spark.createDataFrame([(1, "c1 r3"), (2, "r5"), (3, "c1 c2 c3"), (4, "same TEXT c1"), (5, "unknown"), (6, None), (7, "r1 r2 r3 c9 c9")], "query_id long, query string")
    text_index.build(docs, f"file://{tmp_path}/index")
    built = text_index.open_index(spark, f"file://{tmp_path}/index")
    want = retrieve.top_k(retrieve.bm25(docs, queries).withColumn("score", F.round("score", 6)), 7).select("query_id", "doc_id", "score", "rank")
    got = text_index.search(built, queries, 7)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 25
    # A bound leaves blocks out.
    asked = text_index.worth(built, queries)
    everything = text_index.live_blocks(built, asked.withColumn("kth", F.lit(None).cast("double"))).count()
    kth = got.groupBy("query_id").agg(F.min("score").alias("kth"))
    assert text_index.live_blocks(built, asked.join(kth, "query_id", "left")).count() < everything
    sizes = built.blocks().select(F.size("ids").alias("n")).collect()
    assert max(r["n"] for r in sizes) <= max(4 * block, 30)


def test_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id string, text string")
    queries = spark.createDataFrame([(1, "a word")], "query_id long, query string")
    for name, docs in (("none", none), ("null", spark.createDataFrame([("a", None)], none.schema))):
        text_index.build(docs, f"file://{tmp_path}/{name}")
        assert text_index.search(text_index.open_index(spark, f"file://{tmp_path}/{name}"), queries, 3).collect() == []
