"""Queries over page text, heading inheritance and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.functions import codes
from lexspark.operators import extract, hierarchy
from lexspark.plans.common import registrar, table
from lexspark.session import scratch_path
from lexspark.sources import files, sinks
from lexspark.streaming import incremental

QUERIES: dict = {}
ORACLE: dict = {}
query = registrar(QUERIES, ORACLE)

_CODE = "lpad((p_partkey %% 10000)::VARCHAR, 4, '0') || '.' || lpad(p_size::VARCHAR, 2, '0') || '.10'"
_PAGES = f"SELECT p_partkey // 50 AS page_key, row_number() OVER (PARTITION BY p_partkey // 50 ORDER BY p_partkey) AS pos, {_CODE} AS code, %s AS description FROM part"


def _code() -> Column:
    return F.concat(F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0"), F.lit("."), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit(".10"))


def _pages(spark: SparkSession, d: str, head: str, line: Column) -> DataFrame:
    """Fifty parts a page, a part as ``line`` below ``head``."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line")))), lambda x: x["line"])
    return table(spark, d, "part").groupBy(F.floor(F.col("p_partkey") / 50).alias("page_key")).agg(F.concat(F.lit(head), F.array_join(lines, "\n")).alias("raw"))


@query("q31_markdown_tables", _PAGES % "p_name")
def q31(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("| "), _code(), F.lit(" |  "), F.col("p_name"), F.lit(" ....... | Free |"))
    return extract.extract_rows(_pages(spark, d, "Chapter\n| HS code | Article description | Rate |\n|---|:---:|---|\n", line)).select("page_key", "pos", "code", "description")


@query("q32_line_grammar", _PAGES % "p_brand || ' - ' || p_name")
def q32(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("- **"), F.col("p_brand"), F.lit("**:\n"), _code(), F.lit(" -- "), F.regexp_replace("p_name", " ", "\n"))
    return extract.extract_rows(_pages(spark, d, "", line)).select("page_key", "pos", "code", "description")


@query("q33_suffix_carry", """WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN lpad((event_id % 100000000)::VARCHAR, 8, '0') END AS base, CASE WHEN event_id % 13 < 12 THEN lpad((event_id % 13)::VARCHAR, 2, '0') END AS s FROM events)
SELECT event_id, coalesce(base, last_value(base IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) || s) AS code FROM e""")
def q33(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    e = table(spark, d, "events").select("event_id", "user_id", F.when(k % 3 == 0, F.lpad((k % 100000000).cast("string"), 8, "0")).alias("base"), codes.suffix_value(F.when(k % 13 < 12, (k % 13).cast("string")).otherwise("none")).alias("s"))
    before = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    return e.select("event_id", F.coalesce("base", codes.with_suffix(F.last("base", ignorenulls=True).over(before), F.col("s"))).alias("code"))


#: A nation is a heading, customers are below it, and each has an item: three levels, in files of a hundred customers.
_CODES = "SELECT lpad((n_regionkey + 1)::VARCHAR, 2, '0') AS r, lpad(n_nationkey::VARCHAR, 2, '0') AS n, lpad((c_custkey % 100)::VARCHAR, 2, '0') AS c, n_name, c_name, (n_regionkey + 1)::VARCHAR || '/' || (c_custkey // 100)::VARCHAR AS pdf FROM nation JOIN customer ON c_nationkey = n_nationkey"
_LEVELS = """WITH x AS ({codes}) SELECT DISTINCT pdf, r || {dot} || n AS code, 'nation ' || n_name AS description FROM x
UNION ALL SELECT pdf, r || {dot} || n || {dot} || c, 'nation ' || n_name || ' ' || c_name FROM x
UNION ALL SELECT pdf, r || {dot} || n || {dot} || c || {dot} || '01', 'nation ' || n_name || {middle} || ' item of trade' FROM x"""


def _levels(spark: SparkSession, d: str) -> DataFrame:
    """(pdf, page, pos, code, description): headings on page 0, what is below them on the next ones."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    n = table(spark, d, "nation").select((F.col("n_regionkey") + 1).cast("string").alias("region"), F.concat_ws(".", two(F.col("n_regionkey") + 1), two(F.col("n_nationkey"))).alias("code"), "n_nationkey", "n_name")
    c = n.join(table(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("pdf", F.concat_ws("/", "region", F.floor(F.col("c_custkey") / 100).cast("string")))
    pos, code = F.col("c_custkey").cast("int").alias("pos"), F.concat_ws(".", "code", two(F.col("c_custkey") % 100))
    first = c.select("pdf", "n_nationkey", "code", "n_name").distinct().select("pdf", F.lit(0).alias("page"), F.col("n_nationkey").cast("int").alias("pos"), "code", F.concat(F.lit("- nation  "), "n_name").alias("description"))
    second = c.select("pdf", F.lit(1).alias("page"), pos, code.alias("code"), F.col("c_name").alias("description"))
    third = c.select("pdf", F.lit(2).alias("page"), pos, F.concat(code, F.lit(".01")).alias("code"), F.lit("item  of trade").alias("description"))
    return first.unionByName(second).unionByName(third)


@query("q34_inherit", _LEVELS.format(codes=_CODES, dot="'.'", middle="' ' || c_name"))
def q34(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.inherit(_levels(spark, d)).select("pdf", "code", "description")


@query("q35_inherit_headings", _LEVELS.format(codes=_CODES, dot="'.'", middle="''"))
def q35(spark: SparkSession, d: str) -> DataFrame:
    rows = _levels(spark, d).withColumn("description", F.regexp_replace("description", "^- nation  ", "nation "))
    return hierarchy.inherit(rows, hierarchy.HEADINGS).select("pdf", "code", "description")


@query("q44_stream", ORACLE["q34_inherit"])
def q44(spark: SparkSession, d: str) -> DataFrame:
    """The rows of q34, page by page through a stream that keeps each file's headings as state."""
    base, rows = scratch_path(spark, "stream"), _levels(spark, d)
    for page in range(3):
        rows.where(F.col("page") == page).write.mode("append").parquet(f"{base}/in")
        incremental.ingest(spark, f"{base}/in", f"{base}/out", f"{base}/state", files_per_batch=1000)
    return incremental.read_rows(spark, f"{base}/out").select("pdf", "code", "description")


@query("q50_resume", ORACLE["q34_inherit"])
def q50(spark: SparkSession, d: str) -> DataFrame:
    """The rows of q34 by a run that stops after the first page of each file and by one that resumes from its log."""
    base, rows = scratch_path(spark, "resume"), _levels(spark, d)
    before = hierarchy.inherit(rows.where("page = 0"))
    sinks.append_log(before.groupBy("pdf", "page").agg(F.sort_array(F.collect_list(F.struct("pos", "code", F.col("raw_description").alias("description")))).alias("r")).select("pdf", "page", F.transform("r", lambda x: F.struct(x["code"].alias("code"), x["description"].alias("description"))).alias("rows")), base)
    log = files.read_page_log(spark, base)
    todo = files.unprocessed(rows.select("pdf", "page").distinct(), files.processed_pages(log))
    known = hierarchy.headings_of(hierarchy.inherit(files.rows_of_log(log)))
    after = hierarchy.inherit(rows.join(todo, ["pdf", "page"], "left_semi"), known=known)
    return before.unionByName(after).select("pdf", "code", "description")


@query("q51_context_of_improved_rows", """WITH x AS (SELECT c_custkey // 100 AS f, lpad((c_custkey % 100)::VARCHAR, 2, '0') AS c, c_custkey, c_name, c_mktsegment FROM customer)
SELECT f::VARCHAR AS pdf, '10' || c AS digits, 'improved ' || c_name AS description FROM x WHERE c_custkey % 3 <> 0""")
def q51(spark: SparkSession, d: str) -> DataFrame:
    """Headings that improved rows leave: of four digits with a dot, and telling."""
    k = F.col("c_custkey")
    code = F.concat(F.lit("10."), F.lpad((k % 100).cast("string"), 2, "0"))
    rows = table(spark, d, "customer").select(F.floor(k / 100).cast("string").alias("pdf"), F.lit(1).alias("page"), k.alias("pos"), code.alias("code"), F.when(k % 3 == 0, "other:").otherwise(F.concat(F.lit(" improved "), "c_name")).alias("description"))
    again = rows.where(k % 3 != 0).withColumn("page", F.lit(0)).withColumn("description", F.lit("an earlier text"))
    return hierarchy.headings_of(rows.unionByName(again), hierarchy.HEADINGS)
