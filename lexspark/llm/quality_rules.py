"""Quality rules: a decision list learned by sequential covering, applied as ordered Spark conditions.

Statistics of a text are computed in its row. The labelled rows are counted by cells of a fixed grid of thresholds;
every step of the learner asks those counts for one histogram by statistic and grid line, so the driver only ever
sees as many numbers as the grid has lines, however many rows are labelled. A rule grows by the condition that
gains most information, loses the conditions that don't hold up on rows kept aside, and takes the cells it covers
out before the next rule. The list becomes ``CASE WHEN rule THEN 0 WHEN ... ELSE 1 END``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm.common import table
from lexspark.session import materialise

SPACE = r"[\x20\x09-\x0D]"
#: Thresholds that a condition may use, by statistic.
SHARES = (0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.18, 0.25, 0.35, 0.5, 0.65, 0.8, 0.95)
GRID: dict[str, tuple[float, ...]] = {
    "n_words": (5, 10, 20, 50, 100, 200, 400, 800, 1600, 3200, 6400),
    "word_length": (2, 2.5, 3, 3.5, 4, 4.5, 5, 5.5, 6, 7, 8, 10, 12),
    "symbol_rate": (0.01, 0.02, 0.05, 0.1, 0.2, 0.4, 0.8, 1.2, 1.6, 2.0, 2.5),
    "mark_rate": (0.01, 0.02, 0.05, 0.1, 0.2, 0.4, 0.8, 1.2, 1.6, 2.0, 2.5),
    "upper_share": SHARES,
    "digit_share": SHARES,
    "dup_line_share": SHARES,
    "repeat_share": SHARES,
}
#: The list has at most so many rules of so many conditions; a rule must cover so many rows and be right so often.
MAX_RULES, MAX_CONDITIONS, MIN_COVER, MIN_PRECISION = 8, 4, 5, 0.8


def _without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long), and n_lines, n_upper, n_digits
    and n_marks; columns of these names are replaced. A null text counts as the empty one."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks"]
    docs = docs.drop(*names, "__t", "__w", "__l", "__g", "__s")
    rows = docs.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    rows = rows.withColumn("__w", F.array_remove(F.split("__t", SPACE + "+"), "")).withColumn("__l", F.filter(F.split("__t", "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0))
    # Windows of three words, by hash; a text without a repeated one is done.
    w = F.col("__w")
    rows = rows.withColumn("__g", F.when(F.size(w) >= 3, F.transform(F.slice(w, F.lit(1), F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>")))
    g = F.col("__g")
    some = F.size(F.array_distinct(g)) < F.size(g)
    rows = rows.withColumn("__s", F.when(some, F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))))
    s = F.col("__s")
    again = F.filter(s, lambda x, i: (x["h"] == F.get(s, i + 1)["h"]) | ((i > 0) & (x["h"] == F.get(s, F.greatest(i - 1, F.lit(0)))["h"])))
    covered = F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["at"], x["at"] + 1, x["at"] + 2))))
    t = F.col("__t")
    return (
        rows.withColumn("n_words", F.size("__w").cast("long"))
        .withColumn("word_chars", F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long"))
        .withColumn("n_symbols", (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"))
        .withColumn("n_repeat_words", F.when(s.isNull(), F.lit(0)).otherwise(F.size(covered)).cast("long"))
        .withColumn("n_lines", F.size("__l").cast("long"))
        .withColumn("n_upper", (F.length(t) - _without(t, r"\p{Lu}+")).cast("long"))
        .withColumn("n_digits", (F.length(t) - F.length(F.translate(t, "0123456789", ""))).cast("long"))
        .withColumn("n_marks", (F.length(t) - F.length(F.translate(t, "!?~^=_{}[]\\/", ""))).cast("long"))
        .drop("__t", "__w", "__l", "__g", "__s")
    )


def _share(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)


def _stats() -> dict[str, Column]:
    """The statistics that conditions test, from the counts above."""
    return {
        "n_words": F.col("n_words").cast("double"),
        "word_length": _share("word_chars", "n_words"),
        "symbol_rate": _share("n_symbols", "n_words"),
        "mark_rate": _share("n_marks", "n_words"),
        "upper_share": _share("n_upper", "word_chars"),
        "digit_share": _share("n_digits", "word_chars"),
        "dup_line_share": _share("n_dup_lines", "n_lines"),
        "repeat_share": _share("n_repeat_words", "n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    """``stat`` is at least (or under) line number ``cut`` of its grid."""

    stat: str
    cut: int
    at_least: bool

    def on_bins(self) -> Column:
        return F.col(f"b_{self.stat}") > self.cut if self.at_least else F.col(f"b_{self.stat}") <= self.cut

    def on_stats(self) -> Column:
        line = F.lit(float(GRID[self.stat][self.cut]))
        return _stats()[self.stat] >= line if self.at_least else _stats()[self.stat] < line

    def __str__(self) -> str:
        return f"{self.stat} {'>=' if self.at_least else '<'} {GRID[self.stat][self.cut]:g}"


Rule = tuple[Condition, ...]


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def label_cells(labelled: DataFrame) -> DataFrame:
    """Labelled rows (the statistics, ``label``: 1 good, 0 bad) counted by grid cell: b_<stat> is the number of
    grid lines at or under the value; good, bad are counts of two thirds of the rows, good_aside, bad_aside of
    the third that pruning uses. Rows with a null label don't count."""
    bins = [reduce(lambda a, b: a + b, [(c >= F.lit(float(x))).cast("int") for x in GRID[name]]).alias(f"b_{name}") for name, c in _stats().items()]
    aside = F.pmod(F.xxhash64("doc_id", F.lit("aside")), F.lit(3)) == 0
    count = lambda bad, a: F.sum(((F.col("label") == (0 if bad else 1)) & (F.col("__aside") == a)).cast("long"))
    rows = labelled.where(F.col("label").isNotNull()).select(*bins, "label", aside.alias("__aside"))
    return rows.groupBy(*[f"b_{n}" for n in GRID]).agg(count(True, False).alias("bad"), count(False, False).alias("good"), count(True, True).alias("bad_aside"), count(False, True).alias("good_aside"))


def _histogram(cells: DataFrame) -> dict[str, dict[int, tuple[int, int]]]:
    """(bad, good) by statistic and bin: at most as many rows as the grid has lines and statistics."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("stat"), F.col(f"b_{n}").alias("bin")) for n in GRID]))
    out: dict[str, dict[int, tuple[int, int]]] = {n: {} for n in GRID}
    for r in cells.select(pairs.alias("p"), "bad", "good").groupBy("p.stat", "p.bin").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).collect():
        out[r["stat"]][r["bin"]] = (r["bad"], r["good"])
    return out


def _best_condition(hist: dict[str, dict[int, tuple[int, int]]]) -> tuple[float, Condition, int, int] | None:
    """The condition with the greatest information gain on bad rows, and the counts it leaves."""
    best = None
    for stat in sorted(hist):
        bins = hist[stat]
        all_bad, all_good = (sum(v[i] for v in bins.values()) for i in (0, 1))
        if not all_bad:
            return None
        before = math.log2(all_bad / (all_bad + all_good))
        for cut in range(len(GRID[stat])):
            low_bad, low_good = (sum(v[i] for b, v in bins.items() if b <= cut) for i in (0, 1))
            for at_least, bad, good in ((True, all_bad - low_bad, all_good - low_good), (False, low_bad, low_good)):
                if bad >= MIN_COVER and bad + good < all_bad + all_good:
                    gain = bad * (math.log2(bad / (bad + good)) - before)
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, Condition(stat, cut, at_least), bad, good)
    return best


def learn_rules(labelled: DataFrame) -> list[Rule]:
    """Rules for bad rows, in order. No label, one class only or no rule that is right often enough: none."""
    cells = materialise(label_cells(labelled), "quality-cells")
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        rule: list[Condition] = []
        inside = cells
        while len(rule) < MAX_CONDITIONS and (best := _best_condition(_histogram(inside))):
            rule.append(best[1])
            inside = inside.where(best[1].on_bins())
            if best[3] == 0:
                break
        if not rule:
            break
        # Of the rule and its beginnings, the one that does best on the rows kept aside.
        prefixes = [_all([c.on_bins() for c in rule[: k + 1]]) for k in range(len(rule))]
        sums = [F.sum(F.when(p, F.col(x)).otherwise(0)).alias(f"{x}{k}") for k, p in enumerate(prefixes) for x in ("bad_aside", "good_aside", "bad", "good")]
        seen = cells.agg(*sums).first()
        worth = [((seen[f"bad_aside{k}"] or 0) - (seen[f"good_aside{k}"] or 0)) / max(1, (seen[f"bad_aside{k}"] or 0) + (seen[f"good_aside{k}"] or 0)) for k in range(len(rule))]
        k = max(range(len(rule)), key=lambda i: (worth[i], -i))
        bad, good = (seen[f"{x}_aside{k}"] + seen[f"{x}{k}"] for x in ("bad", "good"))
        if bad < MIN_COVER or bad / (bad + good) < MIN_PRECISION:
            break
        rules.append(tuple(rule[: k + 1]))
        cells = cells.where(~prefixes[k])
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True where no rule holds: one conditional expression, rules in order."""
    if not rules:
        return F.lit(True)
    case = None
    for rule in rules:
        holds = _all([c.on_stats() for c in rule])
        case = F.when(holds, False) if case is None else case.when(holds, False)
    return case.otherwise(True)


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> tuple[DataFrame, list[Rule]]:
    """The statistics of every row with base_failed and kept, and the rules. ``labels``: (doc_id, label).

    Rows with a null id have no label but a verdict; a label for each of several rows with one id counts for all.
    An empty table gives an empty result."""
    rows = text_statistics(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text").drop("text").withColumn("base_failed", base_failed())
    rows = materialise(rows, "quality-stats")
    labelled = rows.where(~F.col("base_failed")).join(labels.select(F.col("doc_id"), F.col(label).alias("label")), "doc_id")
    rules = learn_rules(labelled)
    return rows.withColumn("kept", ~F.col("base_failed") & verdict(rules)), rules


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its counts and verdicts. A null or empty text has no words, so that base_failed is true
    and kept false; rows with a null label aren't learned from; repeated rows each have their row; an empty table has
    none. Texts of any length are read whole."""
    rows, _ = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
