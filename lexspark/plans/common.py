"""Inputs that several queries derive from the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _two(c):  # noqa: ANN001, ANN202
    return F.lpad(c.cast("string"), 2, "0")


def customer_codes(spark: SparkSession, d: str) -> DataFrame:
    """Six-digit codes of customers: region, nation, number."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    j = c.join(n, c.c_nationkey == n.n_nationkey)
    return j.select(F.col("c_custkey").alias("row_id"), F.concat(_two(F.col("n_regionkey") + 1), _two(F.col("n_nationkey")), _two(F.col("c_custkey") % 100)).alias("digits"), F.col("c_name").alias("name"))


CUSTOMER_CODES = "SELECT c_custkey AS row_id, lpad((n_regionkey + 1)::VARCHAR, 2, '0') || lpad(n_nationkey::VARCHAR, 2, '0') || lpad((c_custkey % 100)::VARCHAR, 2, '0') AS digits, c_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey"


def headings(spark: SparkSession, d: str) -> DataFrame:
    """Descriptions of two digits (regions) and four (nations of an even number)."""
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    two = r.select(_two(F.col("r_regionkey") + 1).alias("digits"), F.concat(F.lit("region "), F.col("r_name")).alias("description"))
    four = n.where(F.col("n_nationkey") % 2 == 0).select(F.concat(_two(F.col("n_regionkey") + 1), _two(F.col("n_nationkey"))).alias("digits"), F.concat(F.lit("nation  "), F.col("n_name")).alias("description"))
    return two.unionByName(four)


HEADINGS = """SELECT lpad((r_regionkey + 1)::VARCHAR, 2, '0') AS digits, 'region ' || r_name AS description FROM region
UNION ALL SELECT lpad((n_regionkey + 1)::VARCHAR, 2, '0') || lpad(n_nationkey::VARCHAR, 2, '0'), 'nation  ' || n_name FROM nation WHERE n_nationkey % 2 = 0"""


def part_triples(spark: SparkSession, d: str) -> DataFrame:
    """Attribute schemas out of parts: by name the brands, types and sizes."""
    p = table(spark, d, "part")
    one = lambda name, c: F.struct(F.lit(name).alias("attribute_type"), F.collect_set(c).alias("values"))
    return p.groupBy("p_name").agg(F.map_from_entries(F.array(one("brand", "p_brand"), one("type", "p_type"), one("size", F.col("p_size").cast("string")))).alias("schema")).select(F.col("p_name").alias("product"), "schema", F.lit("s1").alias("schema_id"), F.lit("parts.json").alias("file"))


PART_TRIPLES = """SELECT DISTINCT p_name AS product, t.attribute_type, t.attribute_value FROM part,
LATERAL (VALUES ('brand', p_brand), ('type', p_type), ('size', p_size::VARCHAR)) AS t(attribute_type, attribute_value)"""

#: Case-folded tokens of a text, in SQL.
FOLD = "replace(lower(coalesce({0}, '')), 'ß', 'ss')"


def sql_words(c: str) -> str:
    return rf"regexp_extract_all({FOLD.format(c)}, '[\p{{L}}\p{{N}}]+')"


def sql_space(c: str) -> str:
    return rf"trim(regexp_replace(coalesce({c}, ''), '[\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))"


def registrar(queries: dict, oracle: dict):  # noqa: ANN201
    """A decorator that enters a query, and its SQL if it has some, under a name."""

    def query(name: str, sql: str | None):  # noqa: ANN202
        def add(f):  # noqa: ANN001, ANN202
            queries[name] = f
            if sql:
                oracle[name] = sql
            return f

        return add

    return query
