"""License scans over all runs of consecutive lines.

A unit is any run of lines of a text, so lines, paragraphs and the whole text are units too, and a licence with blank
lines inside, or with code directly below, is found wherever it stands. Words, bigrams and Dice coefficients are those
of ``license_scan``.

Two exact bounds keep it cheap. A run reaches t with a template of n bigrams only if it shares t / 2 * (n + least
size) of them, and so does the text that has the run; most texts don't. Of the others, a run that begins with lines
that share nothing is beaten by the run without them, so runs begin at lines that share something, and grow until they
have more bigrams than the template allows. A run grows by the lines that add a bigram to it only, so by one more than
the template allows at most, however often a text repeats. All of it happens in the row; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm.common import table
from lexspark.llm.license_scan import MAX_TEMPLATES, MIN_DICE, TEMPLATES, _bigrams, _compatible, _normal


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where lambdas use it again and again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _pairs(words: Column) -> Column:
    """Neighbouring words, as often as they occur."""
    return F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))


def _lines(words: Column) -> Column:
    """Of the words by line: bigrams inside, and those with the lines before and after (null at the text's edges)."""
    empty = F.array(F.array().cast("array<string>"))
    before, after = F.concat(empty, F.slice(words, F.lit(1), F.size(words) - 1)), F.concat(F.slice(words, F.lit(2), F.size(words)), empty)
    link = lambda a, b: F.concat(F.get(a, F.size(a) - 1), F.lit(" "), F.get(b, F.lit(0)))
    return F.transform(F.arrays_zip(words.alias("w"), before.alias("x"), after.alias("y")), lambda r: F.struct(_pairs(r["w"]).alias("inner"), link(r["x"], r["w"]).alias("before"), link(r["w"], r["y"]).alias("after")))


def _news(lines: Column) -> Column:
    """(line, seen) of every line but the first, in order: the line adds nothing to a run that begins at line i if 2 * i
    is not above ``seen``. A bigram inside line i has the place 2 * i, the one that links it to the line before 2 * i - 1;
    a line's ``seen`` is the least of the places where its bigrams stood last, or -1."""
    placed = F.flatten(F.transform(lines, lambda x, i: F.concat(F.array(F.struct(x["before"].alias("g"), (2 * i - 1).alias("at"))), F.transform(F.array_distinct(x["inner"]), lambda g: F.struct(g.alias("g"), (2 * i).alias("at"))))))
    last = lambda p: F.transform(p, lambda e, k: F.struct(F.floor((e["at"] + 1) / 2).cast("int").alias("line"), F.when((k > 0) & (F.get(p, k - 1)["g"] == e["g"]), F.get(p, k - 1)["at"]).otherwise(-1).alias("seen")))
    least = lambda e: F.filter(e, lambda x, k: (x["line"] > 0) & ((k == 0) | (F.get(e, k - 1)["line"] != x["line"])))
    return _let(F.sort_array(_let(F.sort_array(F.filter(placed, lambda e: e["g"].isNotNull())), last)), least)


def _best(lines: Column, news: Column, t: Column) -> Column:
    """The greatest Dice coefficient of a template with a run of lines; 0 if none has a fitting size."""

    def grown(at: Column, line: Column) -> Column:
        more = F.when(at["first"], line["inner"]).otherwise(F.concat(F.array(line["before"]), line["inner"]))
        return _let(
            F.when(at["g"].isNotNull(), F.array_union(at["g"], more)),
            lambda g: F.struct(
                F.lit(False).alias("first"),
                F.when(F.size(g) <= t["high"], g).alias("g"),
                F.when(F.size(g).between(t["low"], t["high"]), F.greatest(at["best"], 2.0 * F.size(F.array_intersect(g, t["g"])) / (F.size(g) + F.size(t["g"])))).otherwise(at["best"]).alias("best"),
            ),
        )

    start = F.struct(F.lit(True).alias("first"), F.array().cast("array<string>").alias("g"), F.lit(0.0).alias("best"))
    begins = F.transform(lines, lambda x, i: F.when(F.arrays_overlap(F.concat(x["inner"], F.array(x["after"])), t["g"]), i))
    begins = F.filter(begins, lambda i: i.isNotNull())

    def from_line(i: Column) -> Column:
        more = F.filter(F.slice(news, i + 1, F.size(lines)), lambda n: n["seen"] < 2 * i)
        taken = F.concat(F.array(i), F.transform(F.slice(more, F.lit(1), t["high"] + 1), lambda n: n["line"]))
        return F.aggregate(taken, start, lambda at, j: grown(at, F.get(lines, j)), lambda at: at["best"])

    return F.coalesce(F.array_max(F.transform(begins, from_line)), F.lit(0.0))


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, min_dice: float = MIN_DICE, text: str = "text") -> DataFrame:
    """Adds licenses (names of the templates that a run of lines matches, sorted), best_license and best_dice (of ties
    the first by name); columns of these names are replaced. A text without a match has an empty list and nulls."""
    grams = {name: g for name, t in sorted(templates.items()) if (g := _bigrams(t))}
    if len(grams) > MAX_TEMPLATES:
        raise ValueError(f"{len(grams)} templates; there may be {MAX_TEMPLATES}")
    docs = docs.drop("licenses", "best_license", "best_dice", "__w", "__f", "__m")
    found = "array<struct<neg:double,name:string>>"
    if grams:
        ranges = {name: _compatible(len(g), min_dice) for name, g in grams.items()}
        need = {name: max(1, ceil(min_dice / 2 * (len(g) + ranges[name].start) - 1e-9)) for name, g in grams.items()}
        known = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(ranges[name].start).alias("low"), F.lit(ranges[name].stop - 1).alias("high"), F.lit(need[name]).alias("need"), F.array(*map(F.lit, g)).alias("g")) for name, g in grams.items()])
        every = F.array(*map(F.lit, sorted({x for g in grams.values() for x in g})))
        rows = docs.withColumn("__w", _normal(F.coalesce(F.col(text), F.lit(""))))
        words = F.split(F.trim(F.regexp_replace("__w", r"[ \n]+", " ")), " ")
        shared = _let(words, lambda w: F.array_intersect(_pairs(w), every))
        rows = rows.withColumn("__f", _let(shared, lambda s: F.filter(known, lambda t: F.size(F.array_intersect(t["g"], s)) >= t["need"])))
        by_line = F.filter(F.transform(F.split("__w", "\n"), lambda x: F.filter(F.split(x, " "), lambda w: w != "")), lambda w: F.size(w) > 0)
        match = _let(_let(by_line, _lines), lambda lines: _let(_news(lines), lambda news: F.transform(F.col("__f"), lambda t: F.struct((-_best(lines, news, t)).alias("neg"), t["name"].alias("name")))))
        rows = rows.withColumn("__m", F.when(F.size("__f") > 0, F.filter(match, lambda m: m["neg"] <= -min_dice)).otherwise(F.array().cast(found)))
    else:
        rows = docs.withColumn("__m", F.array().cast(found))
    return (
        rows.withColumn("licenses", F.array_sort(F.transform("__m", lambda m: m["name"])))
        .withColumn("best_license", F.array_min("__m")["name"])
        .withColumn("best_dice", -F.array_min("__m")["neg"])
        .drop("__w", "__f", "__m")
    )


def op9_license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: licenses joined by ``;`` in order of name, the best one and its coefficient to six digits.
    A null or empty text, or one without two words, has an empty text of licenses and nulls; of ties the first name is
    the best; repeated rows each have their row, an empty table none. Texts of any length are read whole."""
    rows = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.array_join("licenses", ";").alias("licenses"), "best_license", F.round("best_dice", 6).alias("best_dice"))
