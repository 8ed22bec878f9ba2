"""Confidence gates and fuzzy matching of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import similarity, text
from lexspark.session import Scratch


def score_at_least(score: Column, minimum: float | None) -> Column:
    """Without a minimum everything passes; with one, a missing score doesn't."""
    return F.lit(True) if minimum is None else F.coalesce(score >= minimum, F.lit(False))


def confident(query: Column, score: Column, minimum: float | None, *texts: Column) -> Column:
    """Passes on words shared with the texts, whatever the score; else by score."""
    return (F.size(text.overlap_tokens(query, *texts)) > 0) | score_at_least(score, minimum)


#: Tokens of other lengths than these are compared with those up to so many characters shorter or longer.
MIN_TOKEN, MAX_APART = 3, 2


def _pieces(tokens: DataFrame, token: str, at_least: float, asked: bool) -> DataFrame:
    """(token, n, m, i, piece): what tokens of lengths n (asked for) and m must share to be as alike as ``at_least``.

    Then at most u of all their characters have no match. Each of these spoils one piece of the token asked for at
    most, so of u + 1 pieces one is in the other token as it is, moved by at most u places. Where there are fewer
    characters than pieces, the lengths must do."""
    size = F.length(token)
    n, m = (size, F.col("other")) if asked else (F.col("other"), size)
    rows = tokens.where(size >= MIN_TOKEN).select(token, F.explode(F.sequence(size - MAX_APART, size + MAX_APART)).alias("other")).where(F.col("other") >= MIN_TOKEN)
    u = (n + m - 2 * F.ceil((n + m) * F.lit(at_least / 2) - 1e-9)).cast("int")
    rows = rows.select(token, n.alias("n"), m.alias("m"), u.alias("u")).where(F.col("u") >= F.abs(F.col("n") - F.col("m")))
    count = F.when(F.col("u") >= F.col("n"), 1).otherwise(F.col("u") + 1)
    rows = rows.withColumn("count", count).select("*", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("i"))
    cut = lambda i: F.floor(F.col("n") * i / F.col("count")).cast("int")
    rows = rows.withColumn("place", cut(F.col("i")) + 1).withColumn("length", F.when(F.col("u") >= F.col("n"), 0).otherwise(cut(F.col("i") + 1) - cut(F.col("i"))))
    if not asked:
        places = F.sequence(F.greatest(F.lit(1), F.col("place") - F.col("u")), F.least(F.col("m") - F.col("length") + 1, F.col("place") + F.col("u")))
        rows = rows.withColumn("place", F.explode(F.when(F.col("length") == 0, F.array(F.lit(1))).otherwise(places)))
    return rows.select(token, "n", "m", "i", F.substring(token, F.col("place"), F.col("length")).alias("piece")).distinct()


def similar_tokens(left: DataFrame, right: DataFrame, at_least: float) -> DataFrame:
    """(qt, ct, similarity) of all distinct tokens qt of ``left`` and ct of ``right`` that are equal or, with three
    characters each and at most two apart in length, as similar as ``at_least`` (over 0.5) by Ratcliff/Obershelp.

    Pairs come from an equi-join by pieces: a token as like as that has one of few pieces of the other unchanged and
    near its place. Only pairs whose letters allow the ratio are compared. All of it stays inside the JVM."""
    if not 0.5 < at_least <= 1:
        raise ValueError("at_least must be over 0.5 and at most 1")
    q, c = left.select("qt").distinct(), right.select("ct").distinct()
    equal = q.join(c, F.col("qt") == F.col("ct")).select("qt", "ct", F.lit(1.0).alias("similarity"))
    pairs = _pieces(q, "qt", at_least, True).join(_pieces(c, "ct", at_least, False), ["n", "m", "i", "piece"]).where(F.col("qt") != F.col("ct")).select("qt", "ct").distinct()
    pairs = pairs.where(similarity.at_most(F.col("qt"), F.col("ct")) >= at_least)
    near = pairs.select("qt", "ct", similarity.ratio(F.col("qt"), F.col("ct")).alias("similarity")).where(F.col("similarity") >= at_least)
    return equal.unionByName(near)


#: Fixed values below: least similarities by a query's size and by a token's length.
def match_threshold(query_size: Column, qt: Column, ct: Column) -> Column:
    n = F.least(F.length(qt), F.length(ct))
    return F.when(query_size != 1, 0.9).when(n >= 6, 0.83).when(n == 5, 0.85).otherwise(0.9)


def fuzzy_thresholds(query: Column, base_avg: float = 0.84, base_max: float = 0.9) -> Column:
    """struct(min_avg, min_max): stricter for a single short word, looser for a single long one."""
    t = F.array_except(text.normalized_tokens(query), F.array(*map(F.lit, text.QUERY_NOISE)))
    n = F.length(F.get(t, F.lit(0)))
    pair = lambda a, m: F.struct(F.lit(float(a)).alias("min_avg"), F.lit(float(m)).alias("min_max"))
    base = pair(base_avg, base_max)
    plain = (F.size(t) != 1) | F.exists(t, lambda x: x.rlike("^[0-9]+$"))
    return (
        F.when(plain, base)
        .when(n <= 3, pair(max(base_avg, 0.95), max(base_max, 0.97)))
        .when(n == 4, pair(max(base_avg, 0.9), max(base_max, 0.93)))
        .when(n == 5, pair(min(base_avg, 0.85), min(base_max, 0.87)))
        .when(n == 6, pair(min(base_avg, 0.82), min(base_max, 0.83)))
        .otherwise(pair(min(base_avg, 0.82), min(base_max, 0.84)))
    )


#: How alike one of the telling tokens of a query must be to one of an object's; fewer tokens tell with a lower one.
TELLING = 0.64


def candidates(forms: DataFrame, sets: DataFrame, held: Scratch) -> DataFrame:
    """(form, object_id) that may reach the average: ``forms`` are (form, qts, t), ``sets`` (object_id, cts).

    An average of a over m tokens leaves at most m (1 - a) to be missing, so of any k tokens of a query one is as alike
    as 1 - m (1 - a) / k to a token of the object. The k rarest ones are asked for, with k as small as ``TELLING``
    allows: frequent tokens make no candidates unless a query has no others."""
    of_sets = sets.select("object_id", F.explode("cts").alias("ct"))
    df = of_sets.groupBy("ct").agg(F.count("*").alias("df")).withColumnRenamed("ct", "qt")
    m = F.size("qts")
    missing = m * (1 - F.col("t.min_avg"))
    k = F.greatest(F.lit(1), F.least(m, F.ceil(missing / (1 - TELLING) - 1e-9).cast("int")))
    of_forms = forms.select("form", F.explode("qts").alias("qt"), k.alias("k"), (1 - missing / k - 1e-9).alias("least")).join(df, "qt", "left")
    rarest = Window.partitionBy("form").orderBy(F.coalesce("df", F.lit(0)), "qt")
    telling = held.table(of_forms.withColumn("n", F.row_number().over(rarest)).where(F.col("n") <= F.col("k")).select("form", "qt", "least"), "fuzzy-telling")
    alike = similar_tokens(telling, of_sets, TELLING)
    return telling.join(alike, "qt").where(F.col("similarity") >= F.col("least")).join(of_sets, "ct").select("form", "object_id").distinct()


def fuzzy_match(queries: DataFrame, objects: DataFrame, query_id: str = "query_id", query: str = "query", object_id: str = "object_id", texts: tuple[str, ...] = ("description",), base_avg: float = 0.84, base_max: float = 0.9) -> DataFrame:
    """(query_id, object_id, avg, best, score): for each query the object whose tokens are most like its own, by
    average and then by best similarity (to twelve digits), of ties the smallest id; only if both reach the query's
    thresholds. Queries with the same tokens, and objects with the same tokens, are compared once.

    Of the ``candidates`` those go whose letters don't allow the average; the rest is compared exactly, each pair of
    tokens once."""
    held = Scratch(queries.sparkSession)
    if base_avg < TELLING:
        raise ValueError(f"base_avg must be {TELLING} or more")
    noise = F.array(*map(F.lit, text.QUERY_NOISE))
    long = lambda c: F.filter(text.normalized_tokens(c), lambda t: F.length(t) >= MIN_TOKEN)
    asked = queries.select(F.col(query_id).alias("query_id"), fuzzy_thresholds(F.col(query), base_avg, base_max).alias("t"), F.array_sort(F.array_except(long(F.col(query)), noise)).alias("qts")).where(F.size("qts") > 0)
    asked = held.table(asked.withColumn("form", F.sha2(F.to_json(F.struct("qts", "t")), 256)), "fuzzy-queries")
    forms = asked.groupBy("form").agg(F.first("qts").alias("qts"), F.first("t").alias("t"))
    found = objects.select(F.col(object_id).alias("object_id"), F.array_sort(long(F.concat_ws(" ", *[F.col(x) for x in texts]))).alias("cts")).where(F.size("cts") > 0)
    sets = held.table(found.groupBy("cts").agg(F.min("object_id").alias("object_id")), "fuzzy-objects")

    near = candidates(forms, sets, held)
    m = F.size("qts")
    apart = lambda a, b: F.abs(F.length(a) - F.length(b)) <= MAX_APART
    bound = lambda a, cts: F.coalesce(F.array_max(F.transform(F.filter(cts, lambda b: apart(a, b)), lambda b: similarity.at_most(a, b))), F.lit(0.0))
    both = near.join(forms, "form").join(sets, "object_id")
    most = F.aggregate("qts", F.lit(0.0), lambda s, a: s + F.when(F.array_contains(F.col("cts"), a), 1.0).otherwise(bound(a, F.col("cts"))))
    kept = held.table(both.where(most >= F.col("t.min_avg") * m - 1e-9).select("form", "object_id", "qts", "cts"), "fuzzy-candidates")

    tokens = kept.select("form", "object_id", F.explode("qts").alias("qt"), "cts").select("form", "object_id", "qt", F.explode("cts").alias("ct")).where(apart("qt", "ct"))
    exact = tokens.select("qt", "ct").distinct().select("qt", "ct", similarity.ratio(F.col("qt"), F.col("ct")).alias("similarity"))
    best = tokens.join(exact, ["qt", "ct"]).groupBy("form", "object_id", "qt").agg(F.max("similarity").alias("s"))
    per = best.groupBy("form", "object_id").agg(F.sum("s").alias("s"), F.max("s").alias("best")).join(forms, "form")
    per = per.select("form", "t", "object_id", "best", F.round(F.col("s") / m, 12).alias("avg"))
    order = F.struct("avg", "best", (-F.col("object_id")).alias("o"))
    top = per.groupBy("form").agg(F.max_by(F.struct("object_id", "avg", "best", "t"), order).alias("r")).select("form", "r.*")
    top = top.where((F.col("avg") >= F.col("t.min_avg")) & (F.col("best") >= F.col("t.min_max")))
    out = held.table(asked.select("query_id", "form").join(top, "form").select("query_id", "object_id", "avg", "best", F.greatest("avg", "best").alias("score")), "fuzzy-match")
    held.keep(out)
    return out
