"""Heading text inherited down the code hierarchy.

A row inherits from the nearest heading above it in the code that stands before it in the file; a heading already
carries what it has inherited itself. Only codes of few lengths are headings, so every length is one window over the
rows that share a prefix of that length: the last heading among the rows before. Rows are spread by file and prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import codes, text

STRUCTURED, HEADINGS = "structured", "headings"
#: Digits of the codes that are headings.
LEVELS = {STRUCTURED: (4, 6, 8), HEADINGS: (4,)}


def prepared(rows: DataFrame, flavour: str) -> DataFrame:
    """Codes and descriptions as they are compared."""
    code = codes.normalize_code(F.col("code")) if flavour == STRUCTURED else text.norm_edges(F.coalesce("code", F.lit("")))
    desc = text.clean_description("description", bullets=True) if flavour == STRUCTURED else text.norm_edges(F.coalesce("description", F.lit("")))
    return rows.withColumn("code", code).withColumn("raw_description", desc)


def _kept(flavour: str, code: Column, digits: Column, raw: Column, said: Column) -> Column:
    """Whether a row's description is kept as a heading."""
    if flavour == STRUCTURED:
        return F.length(digits).isin(*LEVELS[flavour]) & text.is_meaningful_prefix(raw)
    return code.rlike(r"^[0-9]{2}\.[0-9]{2}$") & text.is_meaningful_prefix(said)


def headings_of(rows: DataFrame, flavour: str = STRUCTURED, group: str = "pdf", order: tuple[str, ...] = ("page", "pos")) -> DataFrame:
    """(group, digits, description): the last headings that ``rows`` leave. Rows may come from ``inherit``, or, with a
    raw_description or without, be rows that were improved since: their descriptions are taken as they are."""
    said = text.norm_edges(F.coalesce("description", F.lit("")))
    raw = F.col("raw_description") if "raw_description" in rows.columns else said
    digits = codes.digits_only(F.col("code"))
    found = rows.where((digits != "") & (said != "") & _kept(flavour, F.col("code"), digits, raw, said))
    return found.groupBy(group, digits.alias("digits")).agg(F.max_by(said, F.struct(*order)).alias("description"))


def inherit(rows: DataFrame, flavour: str = STRUCTURED, group: str = "pdf", order: tuple[str, ...] = ("page", "pos"), known: DataFrame | None = None) -> DataFrame:
    """``rows``: group, order columns, code, description. Adds raw_description and replaces description by the
    joined one. The raw text is kept so that a later run can replay it and arrive at the same headings.
    ``known``: headings (group, digits, description) that stand before all rows, as ``headings_of`` gives them for the
    pages of a log that a resumed run has behind it."""
    names = [*rows.columns, *([] if "raw_description" in rows.columns else ["raw_description"])]
    levels = LEVELS[flavour]
    r = prepared(rows, flavour).withColumn("__digits", codes.digits_only(F.col("code"))).withColumn("__known", F.lit(None).cast("string"))
    if known is not None:
        earlier = known.select(group, F.col("digits").alias("__digits"), F.col("description").alias("__known")).where(F.length("__digits").isin(*levels))
        r = r.unionByName(earlier, allowMissingColumns=True)
    # Spark sees that rows dealt by the shortest prefix are dealt for all windows.
    r = r.withColumns({f"__p{k}": F.substring("__digits", 1, k) for k in levels})
    r = r.withColumn("__said", F.coalesce("__known", "raw_description"))
    for i, k in enumerate(levels):
        window = Window.partitionBy(group, *[f"__p{x}" for x in levels[: i + 1]]).orderBy(F.col("__known").isNull(), *order).rowsBetween(Window.unboundedPreceding, -1)
        keeps = F.col("__known").isNotNull() | _kept(flavour, F.col("code"), F.col("__digits"), F.col("raw_description"), F.col("__said"))
        held = F.when((F.length("__digits") == k) & (F.col("__said") != "") & keeps, F.col("__said"))
        r = r.withColumn(f"__h{k}", F.when(F.length("__digits") > k, F.last(held, ignorenulls=True).over(window)))
        upto = levels[i + 1] if i + 1 < len(levels) else None
        now = F.col("__known").isNull() & (F.length("__digits") > k)
        now = now & (F.length("__digits") <= upto) if upto else now
        head = F.coalesce(*[F.col(f"__h{x}") for x in levels[i::-1]])
        takes = now & head.isNotNull() & (F.lit(flavour == STRUCTURED) | (F.col("raw_description") != ""))
        r = r.withColumn("__said", F.when(takes, text.join_descriptions(head, "raw_description")).otherwise(F.col("__said")))
    return r.where(F.col("__known").isNull()).withColumn("description", F.col("__said")).select(*names)


def nearest_ancestor(rows: DataFrame, known: DataFrame, digits: str = "digits", key: str = "row_id") -> DataFrame:
    """The longest proper prefix of each row's digits that ``known`` (digits, description) has: (key, ancestor,
    ancestor_description). Rows without one are missing. An equi-join on exploded prefixes, no range join."""
    exploded = rows.select(key, F.explode(codes.ancestors(F.col(digits))).alias("ancestor"))
    hits = exploded.join(known.select(F.col("digits").alias("ancestor"), F.col("description").alias("ancestor_description")), "ancestor")
    return hits.groupBy(key).agg(F.max_by(F.struct("ancestor", "ancestor_description"), F.length("ancestor")).alias("a")).select(key, "a.*")


def ancestor_texts(rows: DataFrame, known: DataFrame, digits: str = "digits", key: str = "row_id", limit: int = 2) -> DataFrame:
    """(key, context): the first ``limit`` different ancestor texts at eight, six, four and two digits."""
    exploded = rows.select(key, F.posexplode(codes.ancestor_levels(F.col(digits))).alias("level", "ancestor"))
    hits = exploded.join(known.select(F.col("digits").alias("ancestor"), text.norm_space("description").alias("t")), "ancestor").where(F.col("t") != "")
    first = hits.groupBy(key, "t").agg(F.min("level").alias("level")).withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("level"))).where(F.col("n") <= limit)
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]).alias("context"))
