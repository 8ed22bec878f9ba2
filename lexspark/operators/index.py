"""From rows and attribute schemas to the three search tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.functions import codes, text
from lexspark.functions.ids import uuid5


def best_by_key(rows: DataFrame, keys: list[str], length: Column, order: list[str]) -> DataFrame:
    """Of the rows of a key the one with the greatest ``length``, of ties the first in order. The whole row is the
    aggregate, so partial results combine before the shuffle."""
    names = rows.columns
    rank = F.struct(length.alias("n"), *[_descending(rows, c).alias(f"o{i}") for i, c in enumerate(order)])
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*names), rank).alias("r")).select("r.*")


def _descending(rows: DataFrame, c: str) -> Column:
    """Numbers negated; the order columns of a best row must be numeric."""
    if rows.schema[c].dataType.typeName() not in ("integer", "long", "short", "byte", "double", "float"):
        raise TypeError(f"order column {c} is not a number")
    return -F.col(c)


def best_descriptions(rows: DataFrame, order: list[str]) -> DataFrame:
    """(digits, description): by digits the longest description, white space normalised, empty ones left out."""
    d = rows.withColumn("digits", codes.digits_only(F.col("code"))).withColumn("description", text.norm_space("description")).where((F.col("digits") != "") & (F.col("description") != ""))
    return best_by_key(d, ["digits"], F.length("description"), order).select("digits", "description")


def _page(c: str) -> Column:
    return F.coalesce(F.expr(f"try_cast(trim({c}) AS int)"), F.lit(0))


def _object_columns(rows: DataFrame, order: list[str]) -> DataFrame:
    strip = lambda c: text.norm_edges(F.coalesce(F.col(c), F.lit("")))
    return rows.select(strip("code").alias("code"), strip("description").alias("description"), strip("pdf").alias("source_pdf"), _page("page").alias("page"), F.col("country"), *order).withColumn("digits", codes.digits_only(F.col("code")))


def _objects(best: DataFrame, *more: str) -> DataFrame:
    return best.select(
        text.norm_edges(F.concat_ws(" ", *[F.col(c) for c in (*more, "code", "digits", "description")])).alias("text"),
        *more,
        "code",
        "description",
        F.col("description").alias("description_raw"),
        F.array().cast("array<string>").alias("keywords"),
        "digits",
        "source_pdf",
        "page",
    )


def six_digit_objects(rows: DataFrame, order: list[str]) -> DataFrame:
    """One object per code of six digits: the row with the longest stripped description, which may be empty."""
    d = _object_columns(rows, order).where(F.length("digits") == 6)
    return _objects(best_by_key(d, ["digits"], F.length("description"), order))


def national_objects(rows: DataFrame, order: list[str]) -> DataFrame:
    """One object per country and code of 8 to 12 digits from country-specific files."""
    d = _object_columns(rows, order).where(F.length("digits").between(8, 12) & text.is_country_specific("source_pdf"))
    d = d.withColumn("country", F.coalesce(F.nullif(text.norm_edges(F.coalesce("country", F.lit(""))), F.lit("")), text.country_of_path("source_pdf")))
    return _objects(best_by_key(d, ["country", "digits"], F.length("description"), order), "country")


def attribute_triples(schemas: DataFrame, product: str = "product", schema: str = "schema", schema_id: str = "schema_id", source_file: str = "file") -> DataFrame:
    """``schema``: map of attribute type to values. One row per (product, type, value); of repeated triples the one
    with the smallest (schema_id, file)."""
    t = schemas.select(F.col(product).alias("product"), F.coalesce(F.col(schema_id), F.lit("")).alias("schema_id"), F.coalesce(F.col(source_file), F.lit("")).alias("source_file"), F.explode(schema).alias("attribute_type", "values"))
    t = t.select("product", "attribute_type", F.explode("values").alias("attribute_value"), "schema_id", "source_file").where(F.col("attribute_value").isNotNull())
    t = t.groupBy("product", "attribute_type", "attribute_value").agg(F.min(F.struct("schema_id", "source_file")).alias("s"))
    line = F.concat("product", F.lit(": "), "attribute_type", F.lit(" : "), "attribute_value")
    return t.select(line.alias("text"), "product", "attribute_type", "attribute_value", F.array().cast("array<string>").alias("keywords"), "s.schema_id", "s.source_file")


def object_seed(kind: str) -> Column:
    """What an object's id is made of."""
    if kind == "six_digit":
        return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("digits", "code", "text")], F.lit(""))
    parts = ("country", "digits") if kind == "national" else ("product", "attribute_type", "attribute_value")
    return F.array_join(F.array(*[F.coalesce(F.col(c), F.lit("")) for c in parts]), "|")


def upsert(existing: DataFrame | None, objects: DataFrame, kind: str, order: tuple[str, ...] = ()) -> DataFrame:
    """Objects by id over those that exist: a new one replaces the old. Of new ones with one id the last by the
    ``order`` columns stays; of those that tie the last by its columns as JSON, so reruns agree."""
    rank = F.struct(*order, F.to_json(F.struct(*objects.columns)))
    new = objects.withColumn("id", uuid5(object_seed(kind))).groupBy("id").agg(F.max_by(F.struct(*objects.columns), rank).alias("o")).select("o.*", "id")
    return new if existing is None else existing.join(new.select("id"), "id", "left_anti").select(*existing.columns).unionByName(new)


def ensure_table(spark: SparkSession, name: str, df: DataFrame, recreate: bool = False) -> None:
    """A table with this schema; an existing one must have it already unless it is recreated."""
    if recreate:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    if spark.catalog.tableExists(name):
        have = [(f.name, f.dataType) for f in spark.table(name).schema.fields]
        if have != [(f.name, f.dataType) for f in df.schema.fields]:
            raise ValueError(f"table {name} has another schema")
    else:
        df.limit(0).write.saveAsTable(name)


def distinct_terms(objects: DataFrame, column: str) -> DataFrame:
    """The different values of a column, white space normalised, sorted."""
    return objects.select(text.norm_space(column).alias("term")).where(F.col("term") != "").distinct().orderBy("term")


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key in order."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") == 1).drop("__n")
