from lexspark.operators import augment, extract, hierarchy


def rows(df):
    return [(r["code"], r["description"]) for r in df.orderBy("page_key", "pos").collect()]


def pages(spark, *raw):
    return spark.createDataFrame(list(enumerate(raw)), "page_key int, raw string")


def test_tables_with_suffixes_and_continuations(spark):
    raw = """intro
| Heading/ Subheading | Stat. Suffix | Article Description | Rate |
|---|---|---|---|
| 0701 | | Potatoes, fresh or chilled: | |
| 0701.90.50 | | Other | Free |
| | 10 | Certified organic ...... | |
| | 5 | | |
| | | in packages | |
"""
    assert rows(extract.extract_rows(pages(spark, raw))) == [
        ("0701", "Potatoes, fresh or chilled:"),
        ("0701.90.50", "Other"),
        ("0701.90.5010", "Certified organic"),
        ("0701.90.5005", "Certified organic in packages"),
    ]


def test_line_grammar(spark):
    raw = """**07.10** Vegetables, frozen
- Leguminous vegetables,
shelled:
0710.21 -- Peas
0710.22 -- Beans
of all kinds
0710.30 - Spinach
"""
    assert rows(extract.extract_rows(pages(spark, raw))) == [
        ("07.10", "Vegetables, frozen"),
        ("0710.21", "Leguminous vegetables, shelled - Peas"),
        ("0710.22", "Leguminous vegetables, shelled - Beans of all kinds"),
        ("0710.30", "Spinach"),
    ]


def test_pages_without_rows(spark):
    assert rows(extract.extract_rows(pages(spark, "", None, "no code here"))) == []


def test_inheritance_is_transitive_and_ordered(spark):
    data = [("f", 1, 0, "0101", "Live horses and asses"), ("f", 1, 1, "0101.21", "pure-bred animals"), ("f", 2, 0, "0101.21.10", "for racing"), ("f", 2, 1, "0101.29", "Other"), ("g", 1, 0, "0101.21", "alone here")]
    got = hierarchy.inherit(spark.createDataFrame(data, "pdf string, page int, pos int, code string, description string"))
    assert {(r["pdf"], r["code"]): r["description"] for r in got.collect()} == {
        ("f", "0101"): "Live horses and asses",
        ("f", "0101.21"): "Live horses and asses pure-bred animals",
        ("f", "0101.21.10"): "Live horses and asses pure-bred animals for racing",
        ("f", "0101.29"): "Live horses and asses Other",
        ("g", "0101.21"): "alone here",
    }


def test_only_dotted_headings_are_inherited_in_the_other_flavour(spark):
    data = [("f", 1, 0, "07.10", "Vegetables, frozen"), ("f", 1, 1, "0710.21", "Peas"), ("f", 1, 2, "0711", "Preserved vegetables"), ("f", 1, 3, "0711.20", "Olives"), ("f", 1, 4, "0710.22", "")]
    got = hierarchy.inherit(spark.createDataFrame(data, "pdf string, page int, pos int, code string, description string"), hierarchy.HEADINGS)
    assert {r["code"]: r["description"] for r in got.collect()} == {"07.10": "Vegetables, frozen", "0710.21": "Vegetables, frozen Peas", "0711": "Preserved vegetables", "0711.20": "Olives", "0710.22": ""}


def test_joined_descriptions_lose_inner_runs_of_spaces(spark):
    data = [("f", 1, 0, "07.10", "Vegetables,  frozen"), ("f", 1, 1, "0710.21", "Peas  green")]
    got = hierarchy.inherit(spark.createDataFrame(data, "pdf string, page int, pos int, code string, description string"), hierarchy.HEADINGS)
    assert {r["code"]: r["description"] for r in got.collect()}["0710.21"] == "Vegetables, frozen Peas green"


def test_failing_batches_are_halved():
    calls = []

    def provider(items):
        calls.append(len(items))
        if any(i["id"] == "3" for i in items):
            raise RuntimeError
        return [{"id": i["id"], "keywords": ["p"]} for i in items]

    got = augment.halving(provider, lambda items: [{"id": i["id"], "keywords": ["f"]} for i in items], [{"id": str(i)} for i in range(5)])
    assert {r["id"]: r["keywords"][0] for r in got} == {"0": "p", "1": "p", "2": "p", "3": "f", "4": "p"}
    assert calls[0] == 5 and calls.count(1) >= 2
