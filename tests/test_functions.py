import difflib
import unicodedata
import uuid

import pytest
from pyspark.sql import functions as F

from lexspark.functions import codes, ids, nested, similarity, text


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (text.norm_space, "  a b\n\tc ", "a b c"),
        (text.norm_space, None, ""),
        (text.strip_bullets, "-- of cattle", "of cattle"),
        (text.drop_dot_leaders, "Other......... 5", "Other 5"),
        (text.looks_like_rate, "freestone", True),
        (text.looks_like_rate, "5¢/kg", True),
        (text.is_meaningful_prefix, "Other:", False),
        (text.is_meaningful_prefix, "Live animals", True),
        (text.looks_generic, " Other. ", True),
        (text.clean_keyword, "Keywords: 'pepper'.", "pepper"),
        (text.clean_keyword, "胡椒", None),
        (text.clean_keyword, "перец", "перец"),
        (text.cache_id, "a\x00b\nc\rd", "a\tb\tcd"),
        (text.is_country_specific, "x/Country Specific/y.pdf", True),
        (text.tokens, "Straße 12, straße", ["strasse", "12"]),
        (text.query_tokens, "HS code for tea", ["for", "tea"]),
        (text.segments, "A: b : a:: (con.) c", ["A", "b", "c"]),
        (text.normalized_tokens, "Cafés glass", ["cafés", "cafes", "cafe", "glass"]),
    ],
)
def test_text(spark, f, value, want):
    got = one(spark, value, f("c"))
    assert sorted(got) == sorted(want) if isinstance(want, list) else got == want


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (codes.normalize_code, " 0101. 21.", "0101.21"),
        (codes.digits_only, "01.2a", "012"),
        (codes.first_code, "see 0101.21.00 now", "0101.21.00"),
        (codes.first_code, "12345.67890", None),
        (codes.ancestors, "12", []),
        (codes.ancestors, "12345", ["1234", "123", "12"]),
        (codes.ancestor_levels, "0101210010", ["01012100", "010121", "0101", "01"]),
        (codes.suffix_value, "5", "05"),
        (codes.suffix_value, "123", None),
    ],
)
def test_codes(spark, f, value, want):
    assert one(spark, value, f(F.col("c"))) == want


def test_bare_headings_count_only_where_allowed(spark):
    assert one(spark, "0101", codes.code_of_cell(F.col("c"), True)) == "0101"
    assert one(spark, "0101", codes.code_of_cell(F.col("c"), False)) is None


def test_join_descriptions_keeps_what_says_both(spark):
    rows = spark.createDataFrame([("Live horses:", "pure-bred"), ("horses", "Live horses"), ("", "x"), ("y.", "")], "p string, d string")
    assert [r[0] for r in rows.select(text.join_descriptions("p", "d")).collect()] == ["Live horses pure-bred", "Live horses", "x", "y"]


def test_uuid5(spark):
    assert one(spark, "käse|type|x", ids.uuid5(F.col("c"))) == str(uuid.uuid5(uuid.NAMESPACE_DNS, "käse|type|x"))


def assigned():
    """All characters that Unicode names, in texts of 50, each between letters."""
    every = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Co", "Cs")]
    return ["a" + "a".join(every[i : i + 50]) + "a" for i in range(0, len(every), 50)]


def test_fold_and_casefold_of_every_character(spark):
    rows = spark.createDataFrame([(s,) for s in assigned()], "c string").repartition(8)
    rows = rows.select("c", text.fold("c").alias("plain"), text.casefold("c").alias("cased"))
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
    for r in rows.collect():
        assert r["plain"] == "".join(x for x in unicodedata.normalize("NFKD", r["c"]) if not unicodedata.combining(x))
        assert r["cased"] == r["c"].casefold()


@pytest.mark.parametrize("said", [None, "", "ﷺ 한글 ﬁn", "ΣΑΣ ŉ", "नमस्ते", "e\u0301\u0327", "\U0001d400\U0001d7d8", "plain"])
def test_fold_of_texts(spark, said):
    want = "".join(x for x in unicodedata.normalize("NFKD", said or "") if not unicodedata.combining(x))
    assert one(spark, said, text.fold("c")) == want and one(spark, said, text.casefold("c")) == (said or "").casefold()


def test_keywords_from_beyond_the_first_words(spark):
    """Enough keywords at the beginning, or only after many words that are none, or nowhere."""
    for said in (" ".join(f"Word{i} word{i}" for i in range(200)), "of an " * 300 + "Late later LATE latest", "x y " * 100 + "tea", "", None):
        words, telling = {}, {}
        for w in (said or "").split():
            if len(w) >= 2:
                words.setdefault(w.casefold(), w)
            if len(w) >= 3 and w.casefold() not in text.STOP_WORDS:
                telling.setdefault(w.casefold(), w)
        assert one(spark, said, text.fallback_keywords("c")) == list(telling.values())[:8]
        assert one(spark, said, text.clean_keywords(F.split("c", " "), 12)) == list(words.values())[:12]


def test_fallback_keywords_of_context_terms_and_attributes(spark):
    context = F.array(F.lit("Live animals"), F.lit("  "), F.lit(None).cast("string"), F.lit("other horses: LIVE"))
    assert one(spark, "pure-bred, (Horses)", text.fallback_keywords("c", context=context)) == ["pure-bred", "Horses", "Live", "animals"]
    assert one(spark, None, text.fallback_keywords("c", context=context)) == ["Live", "animals", "horses"]
    assert one(spark, "tea", text.fallback_keywords("c", context=F.lit(None).cast("array<string>"))) == ["tea"]
    terms = spark.createDataFrame([(" Green  Tea ", "x"), ("", "an id"), (None, "an id"), ("", None), (" ", "x")], "t string, i string")
    assert [r[0] for r in terms.select(text.term_keywords("t", "i")).collect()] == [["Green Tea"], ["an id"], ["an id"], [], []]
    attributes = spark.createDataFrame([("Tea", "colour", "red:green", "Tea: the colour"), (None, None, None, None)], "p string, k string, v string, s string")
    assert [r[0] for r in attributes.select(text.attribute_keywords("p", "k", "v", "s")).collect()] == [["Tea", "colour", "red", "green", "the"], []]


def test_ratio_keeps_the_order_of_its_arguments(spark):
    rows = spark.createDataFrame([("tide", "diet"), ("diet", "tide")], "a string, b string")
    assert [r[0] for r in rows.select(similarity.ratio(F.col("a"), F.col("b"))).collect()] == [difflib.SequenceMatcher(None, "tide", "diet").ratio(), difflib.SequenceMatcher(None, "diet", "tide").ratio()]


@pytest.mark.parametrize("said", ['{"rows": [1]}', 'Sure: {"rows": [1]} ok', "[1]"])
def test_lenient_json(spark, said):
    assert one(spark, said, F.to_json(nested.lenient_json(F.col("c")))) == '{"rows":[1]}'
    assert one(spark, "none", nested.lenient_json(F.col("c"))) is None


def test_usage_under_any_name(spark):
    usage = lambda s: one(spark, s, nested.usage_map(F.col("c")))
    assert usage('{"promptTokenCount": 3, "candidatesTokenCount": 4}') == usage('{"prompt_tokens": 3, "completion_tokens": 4, "total_tokens": 7}') == {"prompt_tokens": 3, "completion_tokens": 4, "total_tokens": 7}
