"""Queries over text and code expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions import codes, ids, nested, text
from lexspark.operators import augment, hierarchy, index, retrieve
from lexspark.plans.common import CUSTOMER_CODES, HEADINGS, customer_codes, headings, part_triples, registrar, sql_space, sql_words, table

QUERIES: dict = {}
ORACLE: dict = {}


query = registrar(QUERIES, ORACLE)


@query("q01_token_frequency", f"SELECT token, count(*) AS n FROM (SELECT unnest({sql_words('text')}) AS token FROM documents) GROUP BY token")
def q01(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.explode(retrieve.words(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("q02_token_idf", f"""WITH t AS (SELECT doc_id, unnest(list_distinct({sql_words('text')})) AS token FROM documents), n AS (SELECT count(DISTINCT doc_id) AS n FROM t)
SELECT token, count(DISTINCT doc_id) AS df, round(ln((any_value(n.n) + 1) / (count(DISTINCT doc_id) + 1)) + 1, 6) AS idf FROM t, n GROUP BY token""")
def q02(spark: SparkSession, d: str) -> DataFrame:
    from lexspark.operators.lexicon import token_idf

    tokens = table(spark, d, "documents").select(F.col("doc_id").alias("product"), F.explode(text.tokens("text")).alias("token"))
    return token_idf(tokens).select("token", "df", F.round("idf", 6).alias("idf"))


@query("q03_norm_space", f"SELECT doc_id, md5({sql_space('text')}) AS h FROM documents")
def q03(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(text.norm_space("text")).alias("h"))


@query("q04_code_normalise", "SELECT page_id, regexp_replace(url, '[^0-9]', '', 'g') AS digits, trim(regexp_replace(url, '[^0-9.]', '', 'g'), '.') AS code, length(regexp_replace(url, '[^0-9]', '', 'g'))::INT AS n FROM pages")
def q04(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", codes.digits_only(u).alias("digits"), codes.normalize_code(u).alias("code"), codes.digit_length(u).alias("n"))


_CELL = "CASE p_partkey % 4 WHEN 0 THEN 'kg ' || lpad(p_size::VARCHAR, 2, '0') || '.' || lpad((p_partkey % 100)::VARCHAR, 2, '0') || ' net' WHEN 1 THEN '12' || lpad(p_size::VARCHAR, 2, '0') WHEN 2 THEN p_name ELSE lpad((p_partkey % 10000)::VARCHAR, 4, '0') || '.' || lpad(p_size::VARCHAR, 2, '0') || '.10' END"


@query("q05_code_of_cell", f"""WITH c AS (SELECT p_partkey, {_CELL} AS cell FROM part), o AS (SELECT *, regexp_replace(cell, '[^0-9.]', '', 'g') AS o FROM c)
SELECT p_partkey, coalesce(nullif(regexp_extract(o, '(^|[^0-9])([0-9]{{2,4}}(\\.[0-9]{{2,4}}){{1,4}})([^0-9]|$)', 2), ''), CASE WHEN regexp_full_match(o, '[0-9]{{4}}') THEN o END) AS code, regexp_full_match(cell, '[0-9]{{2}}\\.[0-9]{{2}}') AS heading FROM o""")
def q05(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    two = F.lpad(F.col("p_size").cast("string"), 2, "0")
    k = F.col("p_partkey") % 4
    cell = (
        F.when(k == 0, F.concat(F.lit("kg "), two, F.lit("."), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0"), F.lit(" net")))
        .when(k == 1, F.concat(F.lit("12"), two))
        .when(k == 2, F.col("p_name"))
        .otherwise(F.concat(F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0"), F.lit("."), two, F.lit(".10")))
    )
    return p.select("p_partkey", codes.code_of_cell(cell, True).alias("code"), codes.is_heading(cell).alias("heading"))


@query("q06_prefixes", f"SELECT row_id, array_to_string([substr(digits, 1, k) FOR k IN range(length(digits) - 1, 1, -1)], ',') AS prefixes FROM ({CUSTOMER_CODES})")
def q06(spark: SparkSession, d: str) -> DataFrame:
    return customer_codes(spark, d).select("row_id", F.array_join(codes.ancestors(F.col("digits")), ",").alias("prefixes"))


@query("q07_nearest_ancestor", f"""WITH c AS ({CUSTOMER_CODES}), h AS ({HEADINGS})
SELECT row_id, arg_max(h.digits, length(h.digits)) AS ancestor, arg_max(h.description, length(h.digits)) AS ancestor_description FROM c JOIN h ON starts_with(c.digits, h.digits) AND length(h.digits) < length(c.digits) GROUP BY row_id""")
def q07(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.nearest_ancestor(customer_codes(spark, d), headings(spark, d))


@query("q08_ancestor_texts", f"""WITH c AS ({CUSTOMER_CODES}), h AS ({HEADINGS})
SELECT row_id, string_agg({sql_space('h.description')}, '; ' ORDER BY length(h.digits) DESC) AS context FROM c JOIN h ON starts_with(c.digits, h.digits) AND length(h.digits) < length(c.digits) GROUP BY row_id""")
def q08(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.ancestor_texts(customer_codes(spark, d), headings(spark, d)).select("row_id", F.array_join("context", "; ").alias("context"))


@query("q12_keywords", f"""WITH k AS (SELECT doc_id, unnest(string_split({sql_space('text')}, ' ')) AS w, generate_subscripts(string_split({sql_space('text')}, ' '), 1) AS i FROM documents),
c AS (SELECT doc_id, i, trim(w, ' ' || chr(9) || chr(10) || chr(13) || '"''`“”‘’.,;:()[]{{}}<>|\\/') AS w FROM k), g AS (SELECT *, replace(lower(w), 'ß', 'ss') AS key FROM c WHERE length(w) >= 2),
f AS (SELECT doc_id, key, min(i) AS i, arg_min(w, i) AS w FROM g GROUP BY doc_id, key), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM f)
SELECT d.doc_id, coalesce(string_agg(w, ',' ORDER BY i), '') AS keywords FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id AND n <= 12 GROUP BY d.doc_id""")
def q12(spark: SparkSession, d: str) -> DataFrame:
    k = text.clean_keywords(F.split(text.norm_space("text"), " "), 12)
    return table(spark, d, "documents").select("doc_id", F.array_join(k, ",").alias("keywords"))


@query("q13_scripts", rf"SELECT token, NOT regexp_matches(regexp_replace(token, '[\x00-\x7F\x{{C0}}-\x{{24F}}\x{{1E00}}-\x{{1EFF}}\x{{400}}-\x{{52F}}\x{{900}}-\x{{97F}}\x{{600}}-\x{{6FF}}]', '', 'g'), '\p{{L}}') AS allowed FROM (SELECT DISTINCT unnest({sql_words('text')}) AS token FROM documents)")
def q13(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select(F.explode(text.tokens("text")).alias("token")).distinct()
    return t.select("token", text.allowed_scripts("token").alias("allowed"))


@query("q20_batches", "SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 20 AS batch FROM documents")
def q20(spark: SparkSession, d: str) -> DataFrame:
    return nested.with_batches(table(spark, d, "documents").select("doc_id", "source"), "doc_id", 20, "source")


@query("q63_batches_in_order", "SELECT event_id, (row_number() OVER (ORDER BY user_id, event_id) - 1) // 50 AS batch FROM events")
def q63(spark: SparkSession, d: str) -> DataFrame:
    """Batches of all events by user, without a column that spreads them."""
    return nested.with_batches(table(spark, d, "events").select("event_id", "user_id"), ("user_id", "event_id"), 50).select("event_id", "batch")


@query("q21_usage_tally", "SELECT e.event_type AS key, sum((props->>'$.k')::BIGINT)::BIGINT AS n FROM events e GROUP BY 1")
def q21(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.create_map("event_type", F.get_json_object("props", "$.k").cast("long")).alias("usage"))
    return nested.tally(e, "usage")


@query("q22_validation", """SELECT o_custkey, count(*) = count(DISTINCT o_orderkey) AND bool_and(o_orderkey % 7 <> 0) AS complete, bool_and(o_orderkey % 5 <> 0) AS unchanged FROM orders GROUP BY o_custkey""")
def q22(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("index", F.col("o_orderkey")).withColumn("code", F.col("o_orderstatus"))
    changed = F.when(F.col("o_orderkey") % 5 == 0, F.lit("?")).otherwise(F.col("code"))
    pair = lambda c: F.struct("index", c.alias("code"))
    g = o.groupBy("o_custkey").agg(
        F.sort_array(F.collect_list("index")).alias("asked"),
        F.collect_list(F.when(F.col("index") % 7 != 0, F.col("index"))).alias("got"),
        F.sort_array(F.collect_list(pair(F.col("code")))).alias("before"),
        F.sort_array(F.collect_list(pair(changed))).alias("after"),
    )
    return g.select("o_custkey", nested.same_ids(F.col("asked"), F.col("got")).alias("complete"), (nested.same_codes(F.col("before"), F.col("after")) & nested.valid_updates(F.col("before"), F.col("after"))).alias("unchanged"))


@query("q26_adaptive_k", f"""WITH q AS (SELECT p_partkey, list_distinct({sql_words("p_name || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' code' ELSE ' 12 blue' END")}) AS t FROM part),
k AS (SELECT p_partkey, list_filter(t, lambda x: x NOT IN ('hs','hs6','hs8','hs10','hs12','hts','tariff','code','codes','classification','classify','search','find')) AS t FROM q)
SELECT p_partkey, CASE WHEN len(t) = 0 OR len(list_filter(t, lambda x: NOT regexp_full_match(x, '[0-9]+'))) = 0 THEN 20 WHEN len(t) = 1 THEN 75 WHEN len(t) = 2 THEN 50 ELSE 20 END AS k FROM k""")
def q26(spark: SparkSession, d: str) -> DataFrame:
    more = F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 3 == 1, " code").otherwise(" 12 blue")
    return table(spark, d, "part").select("p_partkey", F.concat("p_name", more).alias("q")).select("p_partkey", retrieve.adaptive_k(F.col("q"), 20).alias("k"))


@query("q29_token_variants", f"""WITH t AS (SELECT DISTINCT unnest({sql_words('text')}) AS token FROM documents), f AS (SELECT token, strip_accents(token) AS folded FROM t),
v AS (SELECT token, unnest([token, folded, CASE WHEN regexp_full_match(token, '[\\x00-\\x7f]{{3,}}s') AND token NOT LIKE '%ss' THEN left(token, length(token) - 1) END, CASE WHEN regexp_full_match(folded, '[\\x00-\\x7f]{{3,}}s') AND folded NOT LIKE '%ss' THEN left(folded, length(folded) - 1) END]) AS x FROM f)
SELECT token, string_agg(DISTINCT x, ',' ORDER BY x) AS variants FROM v WHERE x <> '' GROUP BY token""")
def q29(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select(F.explode(text.tokens("text")).alias("token")).distinct()
    return t.select("token", F.array_join(F.array_sort(text.token_variants(F.col("token"))), ",").alias("variants"))


@query("q30_rewrite_predicates", f"""WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INT - 1 AS pos FROM documents), l AS (SELECT doc_id, pos, {sql_space("line")} AS s, CASE WHEN doc_id % 3 = 0 THEN 'US' ELSE '' END AS country, (doc_id % 1000000)::VARCHAR AS code FROM x)
SELECT doc_id, pos, (s = '' OR trim(lower(s), ' .:') IN ('other', 'other: other', 'seed', 'other fruit, fresh. - other') OR length(s) < 80) AS rewrite,
 (contains(lower(s), 'free') OR contains(s, '%') OR contains(s, '¢')) AS rate,
 ((country <> '' AND (length(code) > 8 OR length(code) = 4)) OR s = '' OR regexp_full_match(lower(s), 'other:?\\.?') OR contains(lower(s), 'free') OR contains(s, '%') OR contains(s, '¢') OR len(string_split(s, ' ')) <= 3 OR length(s) < 25) AS row_rewrite FROM l""")
def q30(spark: SparkSession, d: str) -> DataFrame:
    """Of every line of every text."""
    lines = table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "s"))
    l = lines.select("doc_id", "pos", "s", F.when(F.col("doc_id") % 3 == 0, "US").otherwise("").alias("country"), (F.col("doc_id") % 1000000).cast("string").alias("code"))
    return l.select("doc_id", "pos", text.needs_description_rewrite("s").alias("rewrite"), text.looks_like_rate("s").alias("rate"), text.needs_rewrite_row("code", "s", "country").alias("row_rewrite"))


@query("q36_fallback_keywords", f"""WITH k AS (SELECT doc_id, unnest(string_split({sql_space('text')}, ' ')) AS w, generate_subscripts(string_split({sql_space('text')}, ' '), 1) AS i FROM documents),
c AS (SELECT doc_id, i, trim(w, '.,;:()[]{{}}''"') AS w FROM k), g AS (SELECT *, replace(lower(w), 'ß', 'ss') AS key FROM c WHERE length(w) >= 3),
f AS (SELECT doc_id, key, min(i) AS i, arg_min(w, i) AS w FROM g WHERE key NOT IN ('and','or','of','the','a','an','for','with','without','whether','not','other') GROUP BY doc_id, key), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM f)
SELECT d.doc_id, coalesce(string_agg(w, ',' ORDER BY i), '') AS keywords FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id AND n <= 8 GROUP BY d.doc_id""")
def q36(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(text.fallback_keywords("text"), ",").alias("keywords"))


_STOP = "('and','or','of','the','a','an','for','with','without','whether','not','other')"


def _first_words(source: str, key: str, said: str, stop: str, n: int) -> str:
    """SQL: the first ``n`` different words of three letters or more that aren't in ``stop``, of every row."""
    return f"""w0 AS (SELECT {key} AS id, string_split({sql_space(said)}, ' ') AS a FROM {source}), w1 AS (SELECT id, unnest(a) AS w, generate_subscripts(a, 1) AS i FROM w0),
w2 AS (SELECT id, i, trim(w, '.,;:()[]{{}}''"') AS w FROM w1), w3 AS (SELECT id, lower(w) AS key, min(i) AS i, arg_min(w, i) AS w FROM w2 WHERE length(w) >= 3 AND lower(w) NOT IN {stop} GROUP BY 1, 2),
w4 AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS n FROM w3), l AS (SELECT w0.id, coalesce(string_agg(w, ',' ORDER BY i), '') AS keywords FROM w0 LEFT JOIN w4 ON w0.id = w4.id AND n <= {n} GROUP BY w0.id)"""


@query("q64_fallback_answers", f"""WITH c AS ({CUSTOMER_CODES}), h AS ({HEADINGS}),
x AS (SELECT row_id, any_value(name) || ' ' || string_agg(h.description, ' ' ORDER BY length(h.digits) DESC) AS said FROM c JOIN h ON starts_with(c.digits, h.digits) AND length(h.digits) < length(c.digits) GROUP BY row_id),
{_first_words("x", "row_id::VARCHAR", "said", _STOP, 8)} SELECT 'object' AS kind, id, keywords FROM l
UNION ALL SELECT DISTINCT 'term', p_brand || '/' || p_type, p_type FROM part
UNION ALL SELECT * FROM (WITH {_first_words("part", "p_partkey::VARCHAR", "replace(p_name || ' type ' || p_type || ' ' || p_name || ': ' || p_type, ':', ' ')", "('')", 10)} SELECT 'attribute' AS kind, id, keywords FROM l)""")
def q64(spark: SparkSession, d: str) -> DataFrame:
    """Answers without a model for all kinds of items: objects with the descriptions above them, terms, attributes."""
    above = hierarchy.ancestor_texts(customer_codes(spark, d), headings(spark, d)).select("row_id", "context")
    objects = customer_codes(spark, d).join(above, "row_id").select(F.col("row_id").cast("string").alias("id"), F.col("name").alias("description"), "context")
    p = table(spark, d, "part")
    terms = p.select(F.concat_ws("/", "p_brand", "p_type").alias("id"), F.col("p_type").alias("term")).distinct()
    triples = p.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("product"), F.lit("type").alias("attribute_type"), F.col("p_type").alias("attribute_value"), F.concat_ws(": ", "p_name", "p_type").alias("text"))
    parts = [augment.default_answers(i, f"{k}s").select(F.lit(k).alias("kind"), "id", F.array_join("keywords", ",").alias("keywords")) for k, i in (("object", objects), ("term", terms), ("attribute", triples))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("q52_segments", f"""WITH s AS (SELECT doc_id, unnest(string_split(replace(replace({sql_space('text')}, '(con.)', ' '), '(con )', ' '), ':')) AS w, generate_subscripts(string_split(replace(replace({sql_space('text')}, '(con.)', ' '), '(con )', ' '), ':'), 1) AS i FROM documents),
c AS (SELECT doc_id, i, {sql_space('w')} AS w FROM s), f AS (SELECT doc_id, replace(lower(w), 'ß', 'ss') AS key, min(i) AS i, arg_min(w, i) AS w FROM c WHERE w <> '' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM f)
SELECT d.doc_id, count(w) AS n, md5(coalesce(string_agg(w, '|' ORDER BY i), '')) AS segments FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id AND n <= 10 GROUP BY d.doc_id""")
def q52(spark: SparkSession, d: str) -> DataFrame:
    s = text.segments("text")
    return table(spark, d, "documents").select("doc_id", F.size(s).cast("long").alias("n"), F.md5(F.array_join(s, "|")).alias("segments"))


@query("q37_uuid5", r"""WITH s AS (SELECT p_partkey, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(p_name || '|' || p_brand || '|' || p_partkey::VARCHAR)) AS h FROM part)
SELECT p_partkey, substr(h,1,8) || '-' || substr(h,9,4) || '-5' || substr(h,14,3) || '-' || lower(substr('89ab89ab89ab89ab', ('0x' || substr(h,17,1))::INT + 1, 1)) || substr(h,18,3) || '-' || substr(h,21,12) AS id FROM s""")
def q37(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("product"), F.col("p_brand").alias("attribute_type"), F.col("p_partkey").cast("string").alias("attribute_value"))
    return p.select("p_partkey", ids.uuid5(index.object_seed("attribute")).alias("id"))


@query("q43_distinct_terms", "SELECT DISTINCT p_type AS term FROM part ORDER BY 1")
def q43(spark: SparkSession, d: str) -> DataFrame:
    return index.distinct_terms(index.attribute_triples(part_triples(spark, d)).where(F.col("attribute_type") == "type"), "attribute_value")
