"""Toxicity, centroid clustering and periodic runs: plain loops, held-out accuracy and hard rows."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspark.llm import centroids, periodic_runs, toxicity
from lexspark.llm.common import table
from tests.conftest import SF
from tests.llm.test_operators import HARD, SCHEMA, clashing, words


def plain_runs(w, min_words=24, min_periods=3):
    """(start, length, period) of all runs, for every period place by place."""
    smallest = {}
    for p in range(1, len(w) // min_periods + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(min_words, min_periods * p):
                smallest.setdefault((i, j + p - i), p)
            i = max(j, i + 1)
    return sorted(((s, n, p) for (s, n), p in smallest.items()), key=lambda r: (r[0], r[2]))


def plain_rest(w, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_periodic_runs_query_equals_plain_loop(spark):
    got = {r["doc_id"]: tuple(r)[1:] for r in periodic_runs.op13_periodic_runs(spark, SF).collect()}
    docs = table(spark, SF, "documents").collect()
    assert len(got) == len(docs)
    some = 0
    for d in docs:
        w = words(d["text"])
        h = zlib.crc32(str(d["doc_id"]).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w)
        some += len(runs)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, plain_rest(w, runs))]
        assert got[d["doc_id"]] == (len(runs), *best, 1000 * best[1] // best[2] if runs else None, *digests)
    assert some > 50


@pytest.mark.parametrize("pairs", [1, 40, 1 << 20])
def test_runs_of_many_texts_equal_plain_loop(monkeypatch, pairs):
    monkeypatch.setattr(periodic_runs, "CHUNK_PAIRS", pairs)
    random.seed(pairs)
    for _ in range(60):
        texts = []
        for _ in range(4):
            w = [random.randrange(random.choice([1, 2, 3, 60])) for _ in range(random.randrange(90))]
            for _ in range(random.randrange(4) if w else 0):
                a, p = random.randrange(len(w)), random.randrange(1, 20)
                w[a:a] = (w[a : a + p] or [0]) * random.randrange(1, 8)
            texts.append(w)
        ends = np.cumsum([len(w) for w in texts])
        starts = ends - [len(w) for w in texts]
        for least in ((24, 3), (6, 2)):
            got = periodic_runs.runs_of(np.array([x for w in texts for x in w], np.int64), starts, ends, *least).tolist()
            want = [[s + o, s + n + o, p] for w, o in zip(texts, starts.tolist()) for s, n, p in plain_runs(w, *least)]
            assert got == want


def test_runs_survive_hashes_that_err(monkeypatch):
    """With hashes that call everything equal, the comparison of words has to find what is true."""

    class Blind(periodic_runs.Sequences):
        def of(self, starts, ends):
            return np.zeros(len(starts), np.uint64)

    w = [1, 2, 3] * 12 + list(range(40)) + [7] * 30
    monkeypatch.setattr(periodic_runs, "Sequences", Blind)
    got = periodic_runs.runs_of(np.array(w), np.array([0]), np.array([len(w)])).tolist()
    assert [(s, e - s, p) for s, e, p in got] == plain_runs(w)


def test_periodic_runs_on_hard_rows(spark):
    long = " ".join(f"w{i % 40_000}" for i in range(120_000))
    docs = clashing(spark.createDataFrame([*HARD, (90, long, "en", "web", 1), (91, "a b " * 12, "en", "web", 1), (92, "a b " * 11 + "a", "en", "web", 1)], SCHEMA), "runs", "extra")
    rows = periodic_runs.find_runs(docs).collect()
    assert len(rows) == len(HARD) + 3 and "extra" in rows[0].asDict()
    by = {r["doc_id"]: r for r in rows}
    assert by[4]["runs"] == [] and by[4]["collapsed"] == "" and by[5]["collapsed"] == ""
    assert [tuple(r) for r in by[8]["runs"]] == [(0, 60_000, 3)] and by[8]["collapsed"] == "x y z"
    assert [tuple(r) for r in by[90]["runs"]] == [(0, 120_000, 40_000)]
    assert [tuple(r) for r in by[91]["runs"]] == [(0, 24, 2)] and by[92]["runs"] == []
    assert periodic_runs.find_runs(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        periodic_runs.find_runs(docs, min_periods=1)


def plain_clusters(rows, k, rounds):
    """Rows are (id, vector); the same in plain integers."""
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    c = [v for _, v in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        groups = [[v for (_, v), o in zip(kept, of) if o == j] for j in range(len(c))]
        c = [[sum(col) // len(g) for col in zip(*g)] if g else c[j] for j, g in enumerate(groups)]
    return sorted(((-1 if i is None else i), *near(v)[::-1]) for i, v in kept), c


def test_clusters_equal_plain_loop(spark):
    random.seed(3)
    place = [[random.uniform(-9, 9) for _ in range(4)] for _ in range(5)]
    rows = [(i, [random.gauss(m, 0.02 if i % 2 else 2.0) for m in place[i % 5]]) for i in range(400)]
    rows += [(1000 + i, [1.0, -2.0, 0.5, 0.0]) for i in range(300)] + [(7, rows[7][1]), (7, [0.0, 0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    rows += [(2000, None), (2001, []), (2002, [1.0, 2.0]), (2003, [1.0, None, 1.0, 1.0]), (2004, [float("nan")] * 4), (2005, [float("inf"), 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("clash")).repartition(3)
    for k, rounds in ((6, 5), (1, 2), (2_000, 1)):
        found, last = centroids.cluster(df, k, rounds, dims=4)
        want, c = plain_clusters(rows, k, rounds)
        assert last.tolist() == c
        assert sorted((-1 if r["vec_id"] is None else r["vec_id"], r["cluster"], r["distance"]) for r in found.collect()) == want


def test_balls_are_assigned_as_wholes():
    """Far groups need no leaf; the tree loses no vector, and equal ones make one ball."""
    rng = np.random.default_rng(1)
    groups = [rng.integers(-5, 5, (500, 8)) + 10_000 * k for k in range(3)]
    tree = centroids._build(np.concatenate(groups)[rng.permutation(1500)])
    whole, leaves = centroids._filtered(tree, np.array([g[0] for g in groups]))
    assert len(leaves) == 0 and len(whole) <= 8 and sum(tree.balls[b, 1] - tree.balls[b, 0] for b, _ in whole) == 1500
    assert sorted(tree.order.tolist()) == list(range(1500))
    same = centroids._build(np.ones((4_000, 8), np.int64))
    assert len(same.balls) == 1 and same.radius[0] == 0 and same.sums[0].tolist() == [4_000] * 8


def test_clusters_of_nothing_and_of_too_much(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    found, last = centroids.cluster(none, 40, 5)
    assert found.collect() == [] and len(last) == 0
    with pytest.raises(ValueError):
        centroids.cluster(none, 0, 5)
    with pytest.raises(Exception, match="after scaling"):
        centroids.cluster(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>"), 1, 1, dims=2)


def made_up(n):
    """Texts of common words; every fourth is toxic by a word of its own or one that begins so."""
    rng = random.Random(5)
    common = ["".join(rng.choice("aeiourstln") for _ in range(rng.randrange(2, 9))) for _ in range(900)]
    rows = []
    for i in range(n):
        w = [rng.choice(common) for _ in range(rng.randrange(20, 200))]
        if i % 4 == 0:
            w.insert(rng.randrange(len(w)), rng.choice(["Zwackel", "qorpish!", "vexum" + rng.choice(common)]))
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    return rows


def test_toxicity_on_held_out_texts(spark):
    rows = made_up(900)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.where("doc_id % 3 > 0").select("doc_id", "text"), df.select("doc_id", "toxic"))
    got = toxicity.score(df.where("doc_id % 3 = 0"), model).collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) >= 0.97 * len(got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(re.match("zwackel|qorpish|vexum", r["worst"]) for r in got if r["predicted"] and r["toxic"])
    two = toxicity.fit(df.where("doc_id % 3 > 0").select("doc_id", "text"), df.select("doc_id", "toxic"), window=2)
    got = toxicity.score(df.where("doc_id % 3 = 0"), two, window=2).collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) >= 0.9 * len(got)


def test_toxicity_query_on_held_out_documents(spark):
    """Held-out documents with a label; few at this size, so all of them together."""
    sf = SF.replace("0.001", "0.01")
    got = toxicity.op11_toxicity(spark, sf).join(table(spark, sf, "labels").where("toxic is not null").select("doc_id", "toxic"), "doc_id").collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) >= 0.93 * len(got)
    caught = [r["predicted"] for r in got if r["toxic"]]
    assert sum(caught) >= 0.6 * len(caught)


def test_toxicity_on_hard_rows(spark):
    rows = made_up(200)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = df.select("doc_id", "toxic").union(spark.createDataFrame([(1, None), (None, 1), (5, 0), (5, 1)], "doc_id long, toxic int"))
    model = toxicity.fit(df, labels)
    docs = clashing(spark.createDataFrame([*HARD, (90, "tion " * 500_000 + "qorpish", "en", "web", 1), (91, "q" * 3_000_000, "en", "web", 1)], SCHEMA), "score", "gain", "extra")
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(HARD) + 2 and got[0]["extra"] == "clash"
    by = {r["doc_id"]: r for r in got}
    assert by[4]["gain"] == by[5]["gain"] == by[9]["gain"] == 0 and by[4]["worst"] is None and by[4]["score"] == by[5]["score"]
    assert by[90]["worst"] == "qorpish" and by[90]["predicted"] == 1
    assert len({(r["text"], r["score"]) for r in got if r["doc_id"] == 1}) == 1
    assert toxicity.score(docs.limit(0), model).collect() == []
    nothing = toxicity.fit(df.limit(0), labels)
    assert {r["score"] for r in toxicity.score(docs.limit(5), nothing).collect()} == {0.0}


def test_queries_on_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "embeddings"):
        table(spark, SF, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for query in (toxicity.op11_toxicity, centroids.op12_centroids, periodic_runs.op13_periodic_runs):
        assert query(spark, str(tmp_path)).collect() == []
