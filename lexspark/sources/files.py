"""Sources: page logs, row files, attribute schemas, caches, binary documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.functions import text

ROW_COLUMNS = ["pdf", "page", "country", "code", "description"]
PAGE_SCHEMA = "pdf string, page int, dpi int, model string, country string, raw string, error string, usage map<string,bigint>, rows array<struct<code:string,description:string>>, written bigint, commit bigint, row bigint"
CACHE_SCHEMA = "id string, model string, augmented_description string, keywords array<string>"


def read_documents(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """(path, length, content) of all matching files under a folder; their order says nothing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", "length", "content")


def _place() -> Column:
    """Where a line of a text source stands: files by time and name, then their blocks, then lines. Spark deals files
    by size, so a row number alone would not do."""
    m = F.col("_metadata")
    return F.struct(m["file_modification_time"].alias("time"), m["file_path"].alias("path"), m["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("line"))


def _appended() -> Column:
    """Orders records as they were appended: by the number of the commit and of the row in it, which ``append_log``
    writes. Records without them come first, by the time they may carry, then by place in the files."""
    zero = F.lit(0)
    return F.struct(F.coalesce("commit", zero).alias("commit"), F.coalesce("written", zero).alias("written"), F.coalesce("row", zero).alias("row"), _place().alias("at"))


def image_url(content: Column, kind: str = "image/jpeg") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.base64(content))


def read_page_log(spark: SparkSession, path: str) -> DataFrame:
    """A page log of JSON lines; keys may come and go, lines that don't parse are dropped. Adds ``place``, which orders
    records as they were appended."""
    df = spark.read.schema(PAGE_SCHEMA + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return df.withColumn("place", _appended()).where(F.col("_bad").isNull() & F.col("pdf").isNotNull() & F.col("page").isNotNull()).drop("_bad", "written", "commit", "row")


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """A row file with a header; all values are strings, further columns are kept, missing ones refused."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    missing = [c for c in ROW_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing in {path}")
    return df


def read_attribute_schemas(spark: SparkSession, path: str) -> DataFrame:
    """(product, schema_id, file, schema): products with a schema object; values that are no strings are dropped."""
    whole = spark.read.option("wholetext", True).text(path).select(F.try_parse_json("value").alias("v")).where(F.col("v").isNotNull())
    whole.createOrReplaceTempView("__attribute_schemas")
    rows = spark.sql(
        """
        SELECT p.key AS product, coalesce(try_variant_get(p.value, '$.schema_id', 'string'), '') AS schema_id, coalesce(try_variant_get(p.value, '$.file', 'string'), '') AS file,
               t.key AS attribute_type, collect_list(cast(x.value AS string)) AS values
        FROM __attribute_schemas, LATERAL variant_explode(v) AS p, LATERAL variant_explode(try_variant_get(p.value, '$.schema', 'variant')) AS t, LATERAL variant_explode(t.value) AS x
        WHERE schema_of_variant(t.value) LIKE 'ARRAY%' AND schema_of_variant(x.value) = 'STRING' AND p.key IS NOT NULL AND t.key IS NOT NULL
        GROUP BY ALL
        """
    )
    return rows.groupBy("product", "schema_id", "file").agg(F.map_from_entries(F.collect_list(F.struct("attribute_type", "values"))).alias("schema"))


def read_cache(spark: SparkSession, path: str, limit: int = 12) -> DataFrame:
    """(id, model, augmented_description, keywords): of each id the last line as they were appended."""
    df = spark.read.schema(CACHE_SCHEMA + ", written bigint, commit bigint, row bigint, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    df = df.withColumn("_at", _appended()).where(F.col("_bad").isNull() & (F.coalesce("id", F.lit("")) != ""))
    w = Window.partitionBy("id").orderBy(F.col("_at").desc())
    df = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1)
    return df.select("id", "model", F.nullif(text.norm_space("augmented_description"), F.lit("")).alias("augmented_description"), text.clean_keywords(F.col("keywords"), limit).alias("keywords"))


def processed_pages(log: DataFrame) -> DataFrame:
    """(pdf, page) of the records without an error."""
    return log.where(F.coalesce("error", F.lit("")) == "").select("pdf", "page").distinct()


def rows_of_log(log: DataFrame) -> DataFrame:
    """(pdf, page, pos, country, code, description): rows of each page's last record that is no error and not empty."""
    good = log.where((F.coalesce("error", F.lit("")) == "") & (F.size("rows") > 0))
    w = Window.partitionBy("pdf", "page").orderBy(F.col("place").desc())
    last = good.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1)
    rows = last.select("pdf", "page", "country", F.posexplode("rows").alias("pos", "r")).select("pdf", "page", "pos", "country", "r.*")
    return rows.where(F.trim(F.coalesce("code", F.lit(""))) != "")


def unprocessed(pages: DataFrame, done: DataFrame) -> DataFrame:
    return pages.join(done, ["pdf", "page"], "left_anti")
