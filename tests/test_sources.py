import json
import os
from concurrent.futures import ThreadPoolExecutor

import pytest

from pyspark.sql import functions as F

from lexspark.operators import index
from lexspark.sources import files, sinks


def test_page_log_and_rows(spark, tmp_path):
    lines = [
        {"pdf": "a", "page": 1, "rows": [{"code": "0101", "description": "x"}, {"code": " ", "description": "y"}]},
        {"pdf": "a", "page": 2, "error": "late", "rows": []},
        {"pdf": "a", "page": 3, "country": "US", "usage": {"total_tokens": 3}, "rows": [{"code": "0102", "description": "old"}]},
        {"pdf": "a", "page": 3, "rows": [{"code": "0102", "description": "new"}]},
    ]
    (tmp_path / "log.jsonl").write_text("\n".join([*map(json.dumps, lines), "{broken"]))
    log = files.read_page_log(spark, str(tmp_path / "log.jsonl"))
    assert log.count() == 4
    assert {(r["pdf"], r["page"]) for r in files.processed_pages(log).collect()} == {("a", 1), ("a", 3)}
    assert sorted((r["page"], r["code"], r["description"]) for r in files.rows_of_log(log).collect()) == [(1, "0101", "x"), (3, "0102", "new")]


def test_row_files(spark, tmp_path):
    df = spark.createDataFrame([("a.pdf", "1", "", "0101", 'a "b", c')], files.ROW_COLUMNS)
    path = f"file://{tmp_path}/rows"
    sinks.append_rows(df, path)
    sinks.append_rows(df, path)
    assert [tuple(r) for r in files.read_rows(spark, path).select("code", "description").collect()] == [("0101", 'a "b", c')] * 2
    (tmp_path / "old.csv").write_text("pdf,page,code,description\n")
    with pytest.raises(ValueError, match="country"):
        files.read_rows(spark, str(tmp_path / "old.csv"))


def test_attribute_schemas_drop_what_is_no_string(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"tea": {"schema_id": "s", "file": "f", "schema": {"form": ["leaf", 5, "leaf", "powder"]}}, "x": 3, "y": {"file": "f"}}))
    triples = index.attribute_triples(files.read_attribute_schemas(spark, str(tmp_path / "a.json")))
    assert sorted((r["product"], r["attribute_value"], r["schema_id"]) for r in triples.collect()) == [("tea", "leaf", "s"), ("tea", "powder", "s")]


def test_cache_last_line_wins_and_versions(spark, tmp_path):
    lines = ['{"id": "1", "keywords": ["a", "A", "bb", "Bb"]}', "{", '{"id": "1", "augmented_description": " x  y ", "keywords": ["cc"]}', '{"id": "2", "keywords": ["胡椒", "tea"]}']
    (tmp_path / "c.jsonl").write_text("\n".join(lines))
    cache = files.read_cache(spark, str(tmp_path / "c.jsonl"))
    assert {r["id"]: (r["augmented_description"], r["keywords"]) for r in cache.collect()} == {"1": ("x y", ["cc"]), "2": (None, ["tea"])}
    store = sinks.CacheStore(spark, f"file://{tmp_path}/store")
    assert store.read() is None and store.write(cache) == 1 and store.write(cache) == 1 and store.write(cache.where("id = '1'")) == 2
    assert store.read().count() == 1 and store.read(1).count() == 2


@pytest.mark.parametrize("kind", ["cache", "pages"])
def test_last_line_wins_with_equal_file_times(spark, tmp_path, kind):
    """Commits of many rows and parts, whose files all get one time; also lines of one commit that repeat a key."""
    path = f"file://{tmp_path}/log"
    for n in range(6):
        rows = [(f"k{i % 40}", f"{n}-{i}") for i in range(80)]
        df = spark.createDataFrame(rows, "id string, v string").repartitionByRange(1 + n % 3, "v") if n == 0 else spark.createDataFrame(rows, "id string, v string").coalesce(1 + n % 3)
        if kind == "cache":
            sinks.append_log(df.select("id", F.lit("m").alias("model"), F.col("v").alias("augmented_description"), F.array(F.lit("word")).alias("keywords")), path)
        else:
            row = F.array(F.struct(F.lit("0101").alias("code"), F.col("v").alias("description")))
            sinks.append_log(df.select(F.col("id").alias("pdf"), F.lit(1).alias("page"), row.alias("rows")), path)
    for f in (tmp_path / "log").glob("part-*"):
        os.utime(f, (1_000_000, 1_000_000))
    if kind == "cache":
        got = {r["id"]: r["augmented_description"] for r in files.read_cache(spark, path).collect()}
    else:
        got = {r["pdf"]: r["description"] for r in files.rows_of_log(files.read_page_log(spark, path)).collect()}
    assert got == {f"k{i}": f"5-{i + 40}" for i in range(40)}


def test_commits_are_numbered_without_a_clock(spark, tmp_path):
    """Writers at once get numbers of their own; older records, with times, come first."""
    path = f"file://{tmp_path}/log"
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "old.json").write_text('{"id": "a", "model": "m", "augmented_description": "old", "keywords": ["word"], "written": 9000000000000000000}\n')
    taken = [sinks._claim(spark, path) for _ in range(3)]
    with ThreadPoolExecutor(4) as pool:
        taken += pool.map(lambda _: sinks._claim(spark, path), range(8))
    assert sorted(taken) == list(range(1, 12))
    one = spark.createDataFrame([("a", "m", "new", ["word"])], files.CACHE_SCHEMA)
    sinks.append_log(one, path)
    assert files.read_cache(spark, path).first()["augmented_description"] == "new"


def test_upsert_is_idempotent(spark):
    objects = spark.createDataFrame([("US", "01012100", "x"), ("CA", "01012100", "y")], "country string, digits string, description string")
    once = index.upsert(None, objects, "national")
    assert sorted(index.upsert(once, objects, "national").collect()) == sorted(once.collect()) and once.count() == 2


def test_tables_keep_their_schema(spark):
    a = spark.createDataFrame([(1,)], "a int")
    index.ensure_table(spark, "kept", a, recreate=True)
    index.ensure_table(spark, "kept", a)
    with pytest.raises(ValueError, match="schema"):
        index.ensure_table(spark, "kept", a.selectExpr("a AS b"))


def test_binary_documents(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.pdf").write_bytes(b"two")
    (tmp_path / "a.pdf").write_bytes(b"one")
    (tmp_path / "c.PDF").write_bytes(b"no")
    assert sorted(bytes(r["content"]) for r in files.read_documents(spark, str(tmp_path)).collect()) == [b"one", b"two"]


def test_the_last_appended_record_wins_whatever_its_size(spark, tmp_path):
    schema = "pdf string, page int, rows array<struct<code:string,description:string>>"
    for first, last in (("short", "long " * 400), ("long " * 400, "short")):
        path = f"file://{tmp_path}/{first[:5]}"
        for said in (first, last):
            sinks.append_log(spark.createDataFrame([("a", 1, [("0101", said)])], schema), path)
        assert [r["description"] for r in files.rows_of_log(files.read_page_log(spark, path)).collect()] == [last]


def test_upsert_keeps_the_last_of_one_id(spark):
    rows = [("US", "01012100", f"text {i}", i) for i in range(5)]
    got = index.upsert(None, spark.createDataFrame(rows, "country string, digits string, description string, at int"), "national", order=("at",))
    assert [r["description"] for r in got.collect()] == ["text 4"]


def test_data_url(spark):
    assert spark.range(1).select(files.image_url(F.lit(bytearray(b"abc"))).alias("u")).first()["u"] == "data:image/jpeg;base64,YWJj"
