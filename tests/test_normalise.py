"""Whole pages by a normaliser, answers without a model, and batches in one order."""

import pytest
from pyspark.sql import functions as F

from lexspark.functions import nested
from lexspark.operators import augment

SCHEMA = "pdf string, page int, pos int, country string, code string, description string, extra map<string,int>"


def noted(folder, out):
    """A normaliser that notes what it gets, a page a line."""

    def normaliser(country, raw, rows):
        with open(f"{folder}/calls", "a") as f:
            f.write(f"{country}|{raw}|{','.join(r['code'] + ':' + r['description'] for r in rows)}\n")
        return out(rows)

    return normaliser


def pages(spark):
    rows = [("a", 1, i, "US", f"0{i}", f"d{i}", {"k": i}) for i in (2, 0, 1)]
    rows += [("a", 2, 0, None, None, None, None), (None, 1, 0, "US", "07", "no page", None)]
    rows += [("b", 1, 0, "US", "08", "same", None)] * 2
    return spark.createDataFrame(rows, SCHEMA)


def test_pages_are_given_whole_in_order_and_once(spark, tmp_path):
    texts = spark.createDataFrame([("a", 1, "x" * 9000), ("c", 1, "no rows")], "pdf string, page int, raw string")
    better = noted(tmp_path, lambda rows: [{"code": f" {r['code']} ", "description": f" full   {r['description']} "} for r in rows])
    got = augment.normalise_rows(pages(spark), better, texts)
    assert got.columns == pages(spark).columns
    for _ in range(2):
        said = sorted((str(r["pdf"]), r["page"], r["pos"], r["description"], str(r["extra"])) for r in got.collect())
    assert said == [("None", 1, 0, "no page", "None"), *[("a", 1, i, f"full d{i}", str({"k": i})) for i in range(3)], ("a", 2, 0, "full", "None"), ("b", 1, 0, "full same", "None"), ("b", 1, 0, "full same", "None")]
    calls = sorted(line.rstrip("\n") for line in open(tmp_path / "calls"))
    assert calls == sorted([f"US|{'x' * 8000}|00:d0,01:d1,02:d2", "None||:", "US||08:same,08:same"])


@pytest.mark.parametrize(
    "out",
    [
        lambda rows: rows[1:],
        lambda rows: rows + rows[:1],
        lambda rows: [{"code": "99", "description": r["description"] + "!"} for r in rows],
        lambda rows: None,
        lambda rows: [{"description": "no code"} for r in rows if r["code"]] or ["text"],
        lambda rows: 1 / 0,
    ],
)
def test_a_page_whose_answer_does_not_fit_stays(spark, tmp_path, out):
    got = augment.normalise_rows(pages(spark), noted(tmp_path, out))
    key = lambda r: (str(r["pdf"]), r["page"], r["pos"])
    assert sorted(map(str, sorted(got.collect(), key=key))) == sorted(map(str, pages(spark).collect()))


def test_other_orders_do_not_fit_and_no_rows_ask_nothing(spark, tmp_path):
    got = augment.normalise_rows(pages(spark).where("pdf = 'a' AND page = 1"), lambda country, raw, rows: rows[::-1])
    assert sorted(r["description"] for r in got.collect()) == ["d0", "d1", "d2"]
    assert augment.normalise_rows(pages(spark).where("false"), noted(tmp_path, lambda rows: rows)).count() == 0
    assert not (tmp_path / "calls").exists()


def test_batches_in_one_order(spark):
    """A frequent value, nulls, repeated rows; every batch but the last is full and none comes before an earlier row's."""
    rows = [(None, i) for i in range(7)] + [(5, i) for i in range(300)] + [(i % 90, i) for i in range(400)] + [(3, 3)] * 2
    df = spark.createDataFrame(rows, "k int, n int").repartition(7)
    got = nested.with_batches(df, ("k", "n"), 20).collect()
    assert len(got) == len(rows)
    ordered = sorted(got, key=lambda r: (r["k"] is not None, r["k"] or 0, r["n"], r["batch"]))
    assert [r["batch"] for r in ordered] == [i // 20 for i in range(len(rows))]
    assert nested.with_batches(df.where("false"), "k", 20).count() == 0
    assert {r["batch"] for r in nested.with_batches(df, "k", 0).collect()} == {0}


def test_answers_without_a_model(spark):
    objects = spark.createDataFrame([("a", "horses", ["Live animals"]), ("b", None, None)], "id string, description string, context array<string>")
    keywords = lambda items, kind="objects": {r["id"]: r["keywords"] for r in augment.default_answers(items, kind).collect()}
    assert keywords(objects) == {"a": ["horses", "Live", "animals"], "b": []}
    assert keywords(objects.drop("context")) == {"a": ["horses"], "b": []}
    assert keywords(objects.select("id", F.col("description").alias("term")), "terms") == {"a": ["horses"], "b": ["b"]}
    with pytest.raises(ValueError, match="kind"):
        augment.default_answers(objects, "others")
