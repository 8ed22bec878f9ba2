"""Fuzzy matching against a plain loop over all pairs."""

import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from lexspark.functions import similarity as native
from lexspark.functions import text
from lexspark.operators import gate
from lexspark.plans import registry
from lexspark.session import Scratch
from tests.conftest import SF


def forms(s):
    """Tokens, and those of ASCII letters without a plural s; the names have no marks."""
    out = []
    for t in re.findall(r"[^\W_]+", s.lower()):
        out += [t, t[:-1]] if re.fullmatch(r"[\x00-\x7f]{3,}s", t) and not t.endswith("ss") else [t]
    return list(dict.fromkeys(out))


#: Least average and best similarity by the number and length of tokens.
def least(tokens):
    n = len(tokens[0]) if tokens else 0
    if len(tokens) != 1 or any(t.isdigit() for t in tokens):
        return 0.84, 0.9
    return (0.95, 0.97) if n <= 3 else {4: (0.9, 0.93), 5: (0.84, 0.87), 6: (0.82, 0.83)}.get(n, (0.82, 0.84))


def similarity(a, b):
    if a == b:
        return 1.0
    if len(a) < 3 or len(b) < 3 or abs(len(a) - len(b)) > 2:
        return 0.0
    return difflib.SequenceMatcher(None, a, b).ratio()


def test_fuzzy_match_equals_a_plain_loop(spark):
    parts = spark.read.parquet(f"{SF}/part.parquet").select("p_partkey", "p_name").collect()
    first = {}
    for r in parts:
        first[r["p_name"]] = min(first.get(r["p_name"], r["p_partkey"]), r["p_partkey"])
    objects = {i: [t for t in forms(name) if len(t) >= 3] for name, i in first.items()}
    want = {}
    for name in first:
        asked = forms(name[:2] + name[3:])
        low, high = least([t for t in asked if t not in text.QUERY_NOISE])
        q = [t for t in asked if len(t) >= 3 and t not in text.QUERY_NOISE]
        if not q:
            continue
        scored = []
        for i, ts in objects.items():
            best = [max((similarity(a, b) for b in ts), default=0.0) for a in q]
            scored.append((round(sum(best) / len(q), 12), max(best), -i))
        avg, most, i = max(scored)
        if avg >= low and most >= high:
            want[name] = (-i, round(avg, 9), round(most, 9))
    got = {r["query_id"]: (r["object_id"], round(r["avg"], 9), round(r["best"], 9)) for r in registry.QUERIES["q38_fuzzy_match"](spark, SF).collect()}
    assert got == want and len(want) > 10


def test_ratio_equals_difflib(spark):
    """On all pairs of tokens of the names and documents, and on made-up ones of few letters."""
    random.seed(1)
    words = {t for r in spark.read.parquet(f"{SF}/part.parquet").select("p_name").distinct().collect() for t in forms(r["p_name"])}
    words |= {t for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(3).collect() for t in forms(r["text"])}
    words = sorted(words)[:160] + ["".join(random.choice("abc") for _ in range(random.randrange(1, 13))) for _ in range(80)] + ["", "größe", "𝕏𝕏a"]
    df = spark.createDataFrame([(w,) for w in words], "a string")
    got = df.crossJoin(df.withColumnRenamed("a", "b")).select("a", "b", native.ratio(F.col("a"), F.col("b")).alias("r"), native.at_most(F.col("a"), F.col("b")).alias("most")).collect()
    assert len(got) == len(words) ** 2
    for r in got:
        assert r["r"] == pytest.approx(difflib.SequenceMatcher(None, r["a"], r["b"]).ratio(), abs=1e-12), (r["a"], r["b"])
        assert r["most"] is None or not r["a"] + r["b"] or r["most"] >= r["r"] - 1e-12
    assert df.limit(1).select(native.ratio(F.lit(None).cast("string"), F.col("a")).alias("r")).first()["r"] is None


@pytest.mark.parametrize("at_least", [0.55, 0.68, 0.8, 0.9])
def test_similar_tokens_lose_no_pair(spark, at_least):
    random.seed(2)
    words = sorted({"".join(random.choice("abcd") for _ in range(random.randrange(1, 11))) for _ in range(260)} | {"x" * 30 + c for c in "ab"})
    df = spark.createDataFrame([(w,) for w in words], "qt string")
    got = {(r["qt"], r["ct"]): r["similarity"] for r in gate.similar_tokens(df, df.withColumnRenamed("qt", "ct"), at_least).collect()}
    want = {(a, b): s for a in words for b in words if (s := similarity(a, b)) >= at_least}
    assert got == pytest.approx(want)


def names(n, rng):
    """Two words each, one of as many as there are names, one of ten."""
    made = ["".join(rng.choice("aeioubcdfghklmnprst") for _ in range(rng.randrange(5, 10))) for _ in range(n)]
    return [f"{rng.choice(made)} {rng.choice(made[:10])}" for _ in range(n)]


def test_candidates_grow_with_the_rows(spark):
    """Twice the rows make about twice the candidates, though every name has one of ten frequent words."""
    counts = []
    for n in (400, 800):
        rng = random.Random(7)
        df = spark.createDataFrame(list(enumerate(names(n, rng))), "object_id long, description string")
        one = F.struct(F.lit(0.84).alias("min_avg"), F.lit(0.9).alias("min_max")).alias("t")
        tokens = F.array_sort(F.filter(text.normalized_tokens("description"), lambda t: F.length(t) >= 3))
        forms_ = df.select(F.col("object_id").cast("string").alias("form"), tokens.alias("qts"), one)
        counts.append(gate.candidates(forms_, df.select("object_id", tokens.alias("cts")), Scratch(spark)).count())
    assert counts[0] >= 400 and counts[1] < 3 * counts[0] < 0.1 * 400 * 400


def test_fuzzy_match_on_many_names_equals_a_plain_loop(spark):
    rng = random.Random(3)
    objects = names(150, rng) + ["", "and the", "solo"]
    asked = [w[:3] + w[4:] for w in rng.sample(objects[:150], 60)] + ["solo", "sola", "", "hs code"]
    got = gate.fuzzy_match(spark.createDataFrame(list(enumerate(asked)), "query_id long, query string"), spark.createDataFrame(list(enumerate(objects * 2)), "object_id long, description string"))
    want = {}
    for k, query in enumerate(asked):
        low, high = least([t for t in forms(query) if t not in text.QUERY_NOISE])
        q = [t for t in forms(query) if len(t) >= 3 and t not in text.QUERY_NOISE]
        scored = [(round(sum(best) / len(q), 12), max(best), -i) for i, o in enumerate(objects) if q and (ts := [t for t in forms(o) if len(t) >= 3]) for best in [[max(similarity(a, b) for b in ts) for a in q]]]
        if scored and max(scored)[0] >= low and max(scored)[1] >= high:
            want[k] = (-max(scored)[2], *max(scored)[:2])
    assert {r["query_id"]: (r["object_id"], r["avg"], r["best"]) for r in got.collect()} == {k: pytest.approx(v) for k, v in want.items()} and len(want) > 30


def test_fuzzy_match_of_nothing(spark):
    none = spark.createDataFrame([], "query_id long, query string")
    objects = spark.createDataFrame([(1, "green tea"), (2, None)], "object_id long, description string")
    assert gate.fuzzy_match(none, objects).collect() == []
    assert gate.fuzzy_match(spark.createDataFrame([(1, None), (2, "green tee")], "query_id long, query string"), objects.limit(0)).collect() == []
    plan = gate.similar_tokens(objects.select(F.col("description").alias("qt")), objects.select(F.col("description").alias("ct")), 0.8)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
