"""Queries over joins, aggregates and caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions import codes, nested, text
from lexspark.operators import augment, extract, index
from lexspark.plans.common import PART_TRIPLES, part_triples, registrar, sql_space, table
from lexspark.session import scratch_path
from lexspark.sources import files, sinks
from lexspark.sources.buckets import BucketTable

QUERIES: dict = {}
ORACLE: dict = {}
query = registrar(QUERIES, ORACLE)


def _key() -> Column:
    return F.col("p_partkey")



@query("q09_best_descriptions", f"""WITH d AS (SELECT p_partkey, regexp_replace(p_brand, '[^0-9]', '', 'g') AS digits, {sql_space('p_name')} AS description FROM part WHERE p_name <> '')
SELECT digits, description FROM d QUALIFY row_number() OVER (PARTITION BY digits ORDER BY length(description) DESC, p_partkey) = 1""")
def q09(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_brand").alias("code"), F.col("p_name").alias("description"), "p_partkey")
    return index.best_descriptions(rows, ["p_partkey"])


_ROWS = """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'docs/Country Specific/hts_2024.pdf' WHEN 1 THEN 'docs/Country Specific/list.pdf' ELSE 'docs/general/hts.pdf' END AS source_pdf,
 CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR ELSE 'p' END AS page, CASE p_partkey % 4 WHEN 0 THEN 'CA' ELSE '' END AS country, p_name AS description,
 CASE p_partkey % 2 WHEN 0 THEN '10' || lpad((p_partkey % 300)::VARCHAR, 4, '0') || '.00' ELSE lpad((p_partkey % 250)::VARCHAR, 6, '0') END AS code FROM part"""


def _rows(spark: SparkSession, d: str) -> DataFrame:
    pdf = F.when(_key() % 3 == 0, "docs/Country Specific/hts_2024.pdf").when(_key() % 3 == 1, "docs/Country Specific/list.pdf").otherwise("docs/general/hts.pdf")
    code = F.when(_key() % 2 == 0, F.concat(F.lit("10"), F.lpad((_key() % 300).cast("string"), 4, "0"), F.lit(".00"))).otherwise(F.lpad((_key() % 250).cast("string"), 6, "0"))
    page = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("p")
    return table(spark, d, "part").select("p_partkey", pdf.alias("pdf"), page.alias("page"), F.when(_key() % 4 == 0, "CA").otherwise("").alias("country"), F.col("p_name").alias("description"), code.alias("code"))


@query("q10_national_objects", f"""WITH r AS (SELECT *, replace(code, '.', '') AS digits, coalesce(nullif(country, ''), CASE WHEN source_pdf LIKE '%hts%' THEN 'US' ELSE 'UNKNOWN' END) AS c FROM ({_ROWS}) WHERE length(replace(code, '.', '')) BETWEEN 8 AND 12 AND source_pdf LIKE '%/Country Specific/%')
SELECT c AS country, code, digits, description, source_pdf, coalesce(try_cast(page AS INT), 0) AS page, c || ' ' || code || ' ' || digits || ' ' || description AS text FROM r QUALIFY row_number() OVER (PARTITION BY c, digits ORDER BY length(description) DESC, p_partkey) = 1""")
def q10(spark: SparkSession, d: str) -> DataFrame:
    return index.national_objects(_rows(spark, d), ["p_partkey"]).select("country", "code", "digits", "description", "source_pdf", "page", "text")


@query("q10_six_digit_objects", f"""SELECT code, code AS digits, description, source_pdf, coalesce(try_cast(page AS INT), 0) AS page, code || ' ' || code || ' ' || description AS text FROM ({_ROWS}) WHERE length(code) = 6
QUALIFY row_number() OVER (PARTITION BY code ORDER BY length(description) DESC, p_partkey) = 1""")
def q10_six(spark: SparkSession, d: str) -> DataFrame:
    return index.six_digit_objects(_rows(spark, d), ["p_partkey"]).select("code", "digits", "description", "source_pdf", "page", "text")


@query("q11_attribute_triples", f"SELECT *, product || ': ' || attribute_type || ' : ' || attribute_value AS text FROM ({PART_TRIPLES})")
def q11(spark: SparkSession, d: str) -> DataFrame:
    return index.attribute_triples(part_triples(spark, d)).select("product", "attribute_type", "attribute_value", "text")


@query("q14_unprocessed_pages", "SELECT 'corpus' AS pdf, doc_id AS page FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND coalesce(quality, 1) <> 0)")
def q14(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "documents").select(F.lit("corpus").alias("pdf"), F.col("doc_id").alias("page"))
    log = table(spark, d, "labels").select(F.lit("corpus").alias("pdf"), F.col("doc_id").alias("page"), F.when(F.col("quality") == 0, "failed").alias("error"))
    return files.unprocessed(pages, files.processed_pages(log))


_THIN = "(s = '' OR trim(lower(s), ' .:') IN ('other', 'other: other', 'seed', 'other fruit, fresh. - other') OR length(s) < 80)"


@query("q15_pending", f"""WITH o AS (SELECT doc_id::VARCHAR AS id, {sql_space("text")} AS s FROM documents WHERE doc_id IS NOT NULL), c AS (SELECT doc_id::VARCHAR AS id, max(quality) = 1 AS aug, max(toxic) = 0 AS kw FROM labels GROUP BY 1)
SELECT o.id, {_THIN} AS need_rewrite FROM o LEFT JOIN c USING (id) WHERE NOT coalesce(c.kw AND (NOT {_THIN} OR c.aug), false)""")
def q15(spark: SparkSession, d: str) -> DataFrame:
    objects = table(spark, d, "documents").where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("description"))
    held = table(spark, d, "labels").groupBy(F.col("doc_id").cast("string").alias("id")).agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    none = F.array().cast("array<string>")
    cache = held.select("id", F.when(F.col("q") == 1, "said better").alias("augmented_description"), F.when(F.col("t") == 0, F.array(F.lit("word"))).otherwise(none).alias("keywords"))
    return augment.pending(objects, cache).select("id", "need_rewrite")


@query("q16_latest", "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def q16(spark: SparkSession, d: str) -> DataFrame:
    return index.latest(table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("q17_merge_cache", """WITH o AS (SELECT p_partkey::VARCHAR AS id, p_name AS a, p_brand || ',' || p_type AS k FROM part), n AS (SELECT (p_partkey + 100)::VARCHAR AS id, CASE p_partkey % 2 WHEN 0 THEN 'new name' END AS a, CASE WHEN p_partkey % 5 = 0 THEN 'Red,Blue' ELSE '' END AS k FROM part WHERE p_partkey % 3 = 0)
SELECT id, coalesce(n.a, o.a) AS augmented_description, CASE WHEN n.k <> '' THEN n.k ELSE coalesce(o.k, '') END AS keywords FROM o FULL JOIN n USING (id)""")
def q17(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    cache = p.select(_key().cast("string").alias("id"), F.col("p_name").alias("augmented_description"), F.array("p_brand", "p_type").alias("keywords"))
    fresh = F.when(_key() % 5 == 0, F.array(F.lit("Red"), F.lit("red"), F.lit(" Blue."))).otherwise(F.array().cast("array<string>"))
    answers = p.where(_key() % 3 == 0).select((_key() + 100).cast("string").alias("id"), F.when(_key() % 2 == 0, " new  name").otherwise("").alias("augmented_description"), fresh.alias("keywords"))
    return augment.merge_cache(cache, answers).withColumn("keywords", F.array_join("keywords", ","))


@query("q18_cache_ids", """WITH c AS (SELECT (p_partkey // 2)::VARCHAR || chr(9) || 'b' AS id, p_name AS augmented_description, p_size % 3 AS n, p_partkey % 2 = 0 AS old, p_partkey FROM part)
SELECT id, augmented_description, n::INT AS n FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, old DESC) = 1""")
def q18(spark: SparkSession, d: str) -> DataFrame:
    mark = F.when(_key() % 2 == 0, "\n").otherwise("\t")
    words = F.slice(F.array(*map(F.lit, ("one", "two"))), F.lit(1), F.col("p_size") % 3)
    cache = table(spark, d, "part").select(F.concat(F.floor(_key() / 2).cast("string"), mark, F.lit("b")).alias("id"), F.col("p_name").alias("augmented_description"), words.alias("keywords"))
    return augment.normalise_cache_ids(cache).select("id", "augmented_description", F.size("keywords").alias("n"))


@query("q19_term_keywords", f"""WITH t AS ({PART_TRIPLES}), k AS (SELECT *, 'P ' || product || CASE WHEN attribute_type <> 'size' THEN ', T ' || attribute_type ELSE '' END || CASE WHEN length(attribute_value) % 2 = 0 THEN ', own ' || attribute_value ELSE '' END AS keywords FROM t)
SELECT product || chr(9) || attribute_type || chr(9) || attribute_value AS id, keywords, product || ': ' || attribute_type || ' : ' || attribute_value || ' Keywords: ' || keywords AS text FROM k""")
def q19(spark: SparkSession, d: str) -> DataFrame:
    triples = index.attribute_triples(part_triples(spark, d)).withColumn("id", F.concat_ws("\t", "product", "attribute_type", "attribute_value"))
    word = lambda prefix, c: F.array(F.concat(F.lit(prefix), F.col(c))).alias("keywords")
    cache = triples.where(F.length("attribute_value") % 2 == 0).select("id", word("own ", "attribute_value"))
    products = triples.select(F.col("product").alias("term")).distinct().select("term", word("P ", "term"))
    types = triples.where("attribute_type <> 'size'").select(F.col("attribute_type").alias("term")).distinct().select("term", word("T ", "term"))
    return augment.apply_terms(triples, cache, products, types).select("id", F.array_join("keywords", ", ").alias("keywords"), "text")


@query("q19_apply_cache", """SELECT p_partkey::VARCHAR AS id, CASE p_partkey % 3 WHEN 0 THEN 'better ' || p_name ELSE p_name END AS description,
 p_brand || ' ' || p_size || ' ' || CASE p_partkey % 3 WHEN 0 THEN 'better ' || p_name || ' Keywords: ' || p_type WHEN 1 THEN p_name || ' Keywords: ' || p_type ELSE p_name END AS text FROM part""")
def q19_apply(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    none = F.array().cast("array<string>")
    objects = p.select(_key().cast("string").alias("id"), F.col("p_brand").alias("code"), F.col("p_size").cast("string").alias("digits"), F.col("p_name").alias("description"), none.alias("keywords"))
    cache = p.where(_key() % 3 < 2).select(_key().cast("string").alias("id"), F.when(_key() % 3 == 0, F.concat(F.lit("better "), "p_name")).alias("augmented_description"), F.array("p_type", F.lower("p_type")).alias("keywords"))
    return augment.apply_cache(objects, cache).select("id", "description", "text")


def _provider(items: list[dict]) -> list[dict]:
    if any(int(i["id"]) % 7 == 0 for i in items):
        raise RuntimeError("refused")
    return [{"id": i["id"], "augmented_description": i["description"].upper(), "keywords": ["asked"]} for i in items]


def _fallback(items: list[dict]) -> list[dict]:
    return [{"id": i["id"], "augmented_description": None, "keywords": ["fallback"]} for i in items]


@query("q20_provider_batches", "SELECT p_partkey::VARCHAR AS id, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE upper(p_name) END AS augmented_description, CASE WHEN p_partkey % 7 = 0 THEN 'fallback' ELSE 'asked' END AS keywords FROM part")
def q20(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "part").select(_key().cast("string").alias("id"), F.col("p_name").alias("description"))
    return augment.ask(items, _provider, _fallback).withColumn("keywords", F.array_join("keywords", ","))


@query("q21_lenient_json", "SELECT event_id, (props->>'$.k')::INT AS k FROM events")
def q21(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("Here you are: "), "props", F.lit(" - done"))
    return table(spark, d, "events").select("event_id", F.try_variant_get(nested.lenient_json(said), "$.k", "int").alias("k"))


@query("q47_join_descriptions", """WITH r AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN p_name ELSE '' END AS p, p_name AS d FROM part)
SELECT p_partkey, CASE WHEN p = '' THEN d WHEN contains(lower(d), lower(p)) THEN d WHEN contains(lower(p), lower(d)) THEN p ELSE p || ' ' || d END AS joined FROM r""")
def q47(spark: SparkSession, d: str) -> DataFrame:
    prefix = F.when(_key() % 3 == 0, F.concat("p_type", F.lit(" :"))).when(_key() % 3 == 1, F.concat("p_name", F.lit(","))).otherwise("")
    return table(spark, d, "part").select("p_partkey", text.join_descriptions(prefix, "p_name").alias("joined"))


@query("q48_country", f"""SELECT p_partkey, CASE WHEN source_pdf LIKE '%/Country Specific/%' THEN CASE WHEN source_pdf LIKE '%hts%' OR p_partkey % 2 = 0 THEN 'US' ELSE 'UNKNOWN' END END AS country FROM ({_ROWS})""")
def q48(spark: SparkSession, d: str) -> DataFrame:
    first = F.when(_key() % 2 == 0, "Tariff of the United States").otherwise("Tariff")
    return _rows(spark, d).select("p_partkey", text.infer_country("pdf", first).alias("country"))


@query("q49_page_range", "WITH p AS (SELECT p_brand AS pdf, p_partkey AS page FROM part WHERE p_partkey BETWEEN 20 AND 1500 AND p_brand IN (SELECT DISTINCT p_brand FROM part WHERE p_partkey BETWEEN 20 AND 1500 ORDER BY 1 LIMIT 3)) SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY pdf ORDER BY page) <= 4")
def q49(spark: SparkSession, d: str) -> DataFrame:
    return extract.page_range(table(spark, d, "part").select(F.col("p_brand").alias("pdf"), F.col("p_partkey").alias("page")), 20, 1500, max_pages=4, max_files=3)


@query("q53_row_files", f"SELECT source_pdf AS pdf, page, country, code, description FROM ({_ROWS})")
def q53(spark: SparkSession, d: str) -> DataFrame:
    """Rows written to files and read back: nothing is lost by quoting."""
    path = scratch_path(spark, "row-files")
    sinks.append_rows(_rows(spark, d).where(_key() % 2 == 0), path)
    sinks.append_rows(_rows(spark, d).where(_key() % 2 == 1), path)
    return files.read_rows(spark, path).select(*[F.coalesce(c, F.lit("")).alias(c) for c in files.ROW_COLUMNS])


@query("q54_read_cache", "SELECT p_partkey::VARCHAR AS id, 'new ' || p_name AS augmented_description, p_brand || ',' || p_type AS keywords FROM part")
def q54(spark: SparkSession, d: str) -> DataFrame:
    """A cache of JSON lines, of each id the line appended last."""
    path, p = scratch_path(spark, "cache-lines"), table(spark, d, "part")
    for word in ("old ", "new "):
        lines = p.select(_key().cast("string").alias("id"), F.concat(F.lit(word), F.lit(" "), "p_name").alias("augmented_description"), F.array("p_brand", F.upper("p_brand"), "p_type", F.lit("x")).alias("keywords"))
        sinks.append_log(lines, path)
    return files.read_cache(spark, path).withColumn("keywords", F.array_join("keywords", ",")).select("id", "augmented_description", "keywords")


def _improver(targets: list[dict]) -> list[dict]:
    if any(t["index"] % 11 == 0 for t in targets):
        raise RuntimeError("refused")
    if any(t["index"] % 13 == 0 for t in targets):
        return targets[1:]
    return [{**t, "description": f" better  {t['description']} "} for t in targets]


@query("q55_improve_rows", """WITH t AS (SELECT o_custkey, o_orderkey, o_orderstatus || ' ' || o_orderpriority AS d, o_orderkey % 3 <> 0 AS thin FROM orders), p AS (SELECT o_custkey, bool_or(thin AND o_orderkey % 11 = 0) AS refused, bool_or(thin AND o_orderkey % 13 = 0) AS missing FROM t GROUP BY 1)
SELECT o_orderkey AS pos, CASE WHEN NOT thin THEN 'a description that is long enough for all: ' || d WHEN refused OR missing THEN d ELSE 'better ' || d END AS description FROM t JOIN p USING (o_custkey)""")
def q55(spark: SparkSession, d: str) -> DataFrame:
    """A page is a customer's orders; two thirds of them have thin descriptions."""
    said = F.concat_ws(" ", "o_orderstatus", "o_orderpriority")
    said = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("a description that is long enough for all: "), said)).otherwise(said)
    rows = table(spark, d, "orders").select(F.lit("f").alias("pdf"), F.col("o_custkey").alias("page"), F.col("o_orderkey").cast("int").alias("pos"), F.lit("").alias("country"), F.lit("010121").alias("code"), said.alias("description"))
    return augment.improve_rows(rows, _improver).select(F.col("pos").cast("long").alias("pos"), "description")


def _normaliser(country: str | None, raw: str, rows: list[dict]) -> list[dict]:
    """Better descriptions of a whole page, by its country and text; where a code asks for it it fails, leaves a row
    out, or gives its rows in another order."""
    if any(r["code"].startswith("11") for r in rows):
        raise ValueError("refused")
    out = [{"code": r["code"], "description": f" {country}  {raw} {r['description']}"} for r in rows]
    if any(r["code"].startswith("13") for r in rows):
        return out[1:]
    return out[::-1] if any(r["code"].startswith("17") for r in rows) else out


@query("q65_normalise_rows", """WITH t AS (SELECT o_custkey, o_orderkey, o_orderstatus || ' ' || o_orderpriority AS d, CASE WHEN o_orderkey % 11 = 0 THEN '11' WHEN o_orderkey % 13 = 0 THEN '13' WHEN o_orderkey % 17 = 0 THEN '17' ELSE '19' END AS k FROM orders),
p AS (SELECT o_custkey, bool_or(k IN ('11', '13')) OR (bool_or(k = '17') AND count(*) > 1) AS stays FROM t GROUP BY 1)
SELECT o_orderkey AS pos, CASE WHEN stays THEN d ELSE 'US customer ' || o_custkey::VARCHAR || ' ' || d END AS description FROM t JOIN p USING (o_custkey)""")
def q65(spark: SparkSession, d: str) -> DataFrame:
    """A page is a customer's orders; all of its rows are asked for at once."""
    k = F.col("o_orderkey")
    code = F.concat(F.when(k % 11 == 0, "11").when(k % 13 == 0, "13").when(k % 17 == 0, "17").otherwise("19"), k.cast("string"))
    rows = table(spark, d, "orders").select(F.lit("f").alias("pdf"), F.col("o_custkey").alias("page"), k.alias("pos"), F.lit("US").alias("country"), code.alias("code"), F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("description"))
    texts = table(spark, d, "customer").select(F.lit("f").alias("pdf"), F.col("c_custkey").alias("page"), F.concat(F.lit("customer "), F.col("c_custkey").cast("string")).alias("raw"))
    return augment.normalise_rows(rows, _normaliser, texts).select("pos", "description")


@query("q56_refresh", "SELECT p_partkey::VARCHAR AS id, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE upper(p_name) END AS augmented_description, CASE WHEN p_partkey % 7 = 0 THEN 'fallback' ELSE 'asked' END AS keywords, CASE WHEN p_partkey % 7 = 0 THEN 2 ELSE 1 END::BIGINT AS asked FROM part")
def q56(spark: SparkSession, d: str) -> DataFrame:
    """A cache built in three parts, each stored; a second call finds nothing pending but what has no better text. How
    often an item was asked for is in the journals."""
    store = sinks.CacheStore(spark, scratch_path(spark, "cache-store"))
    items = table(spark, d, "part").select(_key().cast("string").alias("id"), F.col("p_name").alias("description"))
    augment.refresh(store, items, _provider, _fallback, rounds=3, calls_per_task=50)
    cache = augment.refresh(store, items, _provider, _fallback, calls_per_task=50).withColumn("keywords", F.array_join("keywords", ","))
    return cache.join(store.answered().groupBy("id").agg(F.count("*").alias("asked")), "id", "left")


@query("q59_national_country", f"SELECT p_partkey, CASE WHEN length(regexp_replace(code, '[^0-9]', '', 'g')) > 8 THEN country ELSE '' END AS country FROM (SELECT p_partkey, country, CASE WHEN p_partkey % 3 = 0 THEN code || '.1234' ELSE code END AS code FROM ({_ROWS}))")
def q59(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d).withColumn("code", F.when(_key() % 3 == 0, F.concat("code", F.lit(".1234"))).otherwise(F.col("code")))
    return rows.select("p_partkey", codes.national_country(F.col("code"), F.col("country")).alias("country"))


@query("q62_bucket_merge", """SELECT 'US' AS country, lpad(c_custkey::VARCHAR, 8, '0') AS digits, CASE WHEN c_acctbal < 0 THEN 'owes ' ELSE '' END || c_name AS description FROM customer
UNION ALL SELECT 'CA', lpad(s_suppkey::VARCHAR, 8, '0'), s_name FROM supplier""")
def q62(spark: SparkSession, d: str) -> DataFrame:
    """Objects of customers in buckets, into which those that owe and then suppliers are merged."""
    store, c, s = BucketTable(spark, scratch_path(spark, "objects")), table(spark, d, "customer"), table(spark, d, "supplier")
    of = lambda rows, country, key, said: rows.select(F.lit(country).alias("country"), F.lpad(F.col(key).cast("string"), 8, "0").alias("digits"), said.alias("description"))
    for objects in (of(c, "US", "c_custkey", F.col("c_name")), of(c.where("c_acctbal < 0"), "US", "c_custkey", F.concat(F.lit("owes "), "c_name")), of(s, "CA", "s_suppkey", F.col("s_name"))):
        store.merge(index.upsert(None, objects, "national"))
    return store.read().select("country", "digits", "description")
