"""Every operator on hard rows: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexspark.llm import bpe, components, language_id, license_scan, line_dedup, lm_scoring, minhash, mixing, quality_rules, registry, sharding, topk
from lexspark.llm.common import table
from tests.conftest import SF

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the quick brown fox jumps over the lazy dog while seven wizards quietly brew strong coffee near old harbour walls at dawn".split()
BASE = " ".join(WORDS * 3)
HARD = [
    (1, BASE, "en", "web", 1),
    (1, BASE, "en", "web", 1),
    (2, BASE.upper(), "en", "web", 2),
    (3, BASE + " once more", "en", None, 3),
    (4, None, None, "web", None),
    (5, "", "en", "", 0),
    (6, " \n\t ", "de", "web", 4),
    (None, "solo", "en", "web", 4),
    (None, None, None, None, None),
    (7, "solo", "de", "books", 4),
    (8, "x y z " * 20_000, "fr", "books", 120_000),
    (9, "12 34 !!! ###", "fr", "books", 13),
    (10, "a\nb\nc\nd\ne\nf\ng\nh\ni\nj\nk", "de", "books", 9),
    (11, "z\na\nb\nc\nd\ne\nf\ng\nh\ni\nj\nk", "de", "books", 9),
    (12, "Größe übt 😀 naïve <|endoftext|>   end ", "de", "chat", 9),
]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(HARD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df, *names):
    return df.withColumns({n: F.lit("clash") for n in names})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("name", list(registry.ORACLE))
def test_query_equals_sql(spark, same_as_sql, name):
    same_as_sql(registry.QUERIES[name](spark, SF), registry.ORACLE[name])


# 1


def test_sharding_tiers_versions_and_conflicts(spark, hard, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/t", target_bytes=1 << 20, fan_in=2)
    key = lambda df: sorted(map(str, df.select(*hard.columns).collect()))
    for _ in range(3):
        store.append(clashing(hard, "path").coalesce(1))
    assert key(store.read()) == sorted(3 * key(hard))
    tiers = Counter(map(store.tier, store.shards()))
    assert max(tiers.values()) < 2
    old = store.manifest()
    store.append(clashing(hard.limit(0), "path"))
    with pytest.raises(sharding.CommitConflict):
        store._commit(old, old["schema"], [])
    with pytest.raises(ValueError, match="schema"):
        store.append(hard)


def test_sharding_by_arrival_and_empty(spark, hard, empty, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/t")
    store.append(empty.withColumn("arrival", F.lit(1)), arrival="arrival")
    store.append(hard.withColumn("arrival", F.lit(2)), arrival="arrival")
    assert store.read().count() == len(HARD)


# 2


def brute_dedup(rows):
    """Each chunk's first place by (no id, id, key, place); rows of one id and text are one document."""
    key = lambda i, t: hashlib.md5(("\x00" if i is None else str(i)).encode() + b"\x1f" + ("\x00" if t is None else t).encode()).digest()
    docs = {(i is None, i or 0, key(i, t)): t for i, t in rows}
    chunks = {d: [(a, b, "\n".join(t.split("\n")[a:b])) for a, b in line_dedup.chunk_lines(t.split("\n"))] if t else [] for d, t in docs.items()}
    first = {}
    for d in sorted(chunks):
        for k, (a, b, body) in enumerate(chunks[d]):
            if b - a >= 2 and body.strip():
                first.setdefault(body, (d, k))
    out = {}
    for d, cs in chunks.items():
        t = docs[d]
        stays = [body for k, (a, b, body) in enumerate(cs) if first.get(body, (d, k)) == (d, k)]
        out[d] = t if len(stays) == len(cs) else "\n".join(stays)
    return sorted(str(out[(i is None, i or 0, key(i, t))]) for i, t in rows)


def test_line_dedup_equals_brute_force(spark, hard):
    passage = "\n".join(f"shared line {i}" for i in range(40))
    more = [(100 + i, f"own {i}\n" * (i % 3) + passage + f"\ntail {i}", "en", "web", 1) for i in range(20)]
    docs = hard.unionByName(spark.createDataFrame(more, SCHEMA))
    got = line_dedup.dedup_lines(clashing(docs, "n_lines", "hits"))
    assert sorted(str(r["text"]) for r in got.collect()) == brute_dedup([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert got.where("doc_id > 100 AND text LIKE '%shared line 20%'").count() == 0


# 3


def test_language_id_is_right_on_held_out_texts(spark):
    rows = language_id.op3_language_id(spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id")
    held = rows.where("held_out AND lang IS NOT NULL")
    assert held.where("lang = lang_pred").count() / held.count() > 0.97
    assert rows.where("held_out").count() == sum(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows.collect())


def test_language_id_equals_a_plain_loop(spark, hard):
    import zstandard

    docs = hard.unionByName(table(spark, SF, "documents"))
    held = language_id.fit_dictionaries(docs.select("text", "lang"))
    assert all(0 < len(d) <= language_id.DICT_BYTES for d in held.values())
    params = zstandard.ZstdCompressionParameters(window_log=17, hash_log=15, chain_log=16, search_log=4, min_match=4, target_length=16, strategy=zstandard.STRATEGY_LAZY, write_content_size=0, write_checksum=0, write_dict_id=0)
    for r in language_id.identify(docs, held).collect():
        t = r["text"]
        want = ("und", 0.0, False)
        if t and any(map(str.isalpha, t)):
            data = " ".join(re.split("[ \t\n\v\f\r]+", "".join(c for c in t.lower() if ord(c) > 127 or c.isalpha() or c in " \t\n\v\f\r").strip(" \t\n\v\f\r"))).encode()
            sizes = []
            for lang, d in held.items():
                total = 0
                for at in range(0, max(1, len(data)), language_id.PIECE_BYTES):
                    c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)
                    total += len(c.compress(data[at : at + language_id.PIECE_BYTES]))
                sizes.append((total, lang))
            (a, lang), (b, _) = sorted(sizes)[:2]
            want = (lang, (b - a) / b, (b - a) / b >= language_id.MIN_MARGIN)
        assert (r["lang_pred"], r["score"], r["accepted"]) == want


def test_language_id_on_hard_rows(spark, hard, empty):
    d = language_id.fit_dictionaries(hard.select("text", "lang"))
    got = language_id.identify(clashing(hard, "score"), d)
    assert got.count() == len(HARD)
    undetermined = {str(r["text"]) for r in got.where("lang_pred = 'und'").collect()}
    assert undetermined == {"None", "", " \n\t ", "12 34 !!! ###"} and got.where("lang_pred = 'und' AND accepted").count() == 0
    assert got.where("score < 0 OR score > 1").count() == 0
    assert language_id.identify(empty, {}).count() == 0
    assert language_id.identify(hard, {}).where("lang_pred <> 'und'").count() == 0


# 4


def test_bpe_equals_the_tokenizers_library(spark, hard):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    library.no_truncation()
    library.no_padding()
    docs = hard.unionByName(table(spark, SF, "documents"))
    for r in bpe.encode(clashing(docs, "ids"), decoded="decoded").collect():
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert list(np.frombuffer(r["ids"], "<u4")) == want
        assert r["decoded"] == library.decode(want, skip_special_tokens=False)
        assert r["decoded"] == (r["text"] or "")


def test_bpe_decode_is_the_inverse(hard, empty):
    rows = bpe.decode(bpe.encode(hard)).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in rows)
    assert bpe.encode(empty).count() == 0


# 5


def test_lm_counts_and_base_score_equal_brute_force(spark, hard):
    docs = hard.unionByName(table(spark, SF, "documents"))
    model, counts = lm_scoring.train(docs.where("doc_id % 2 = 0 OR doc_id IS NULL"))
    low = lambda t: [w for w in words(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))] + [None]
    rows = docs.collect()
    seen = Counter(w for r in rows if r["doc_id"] is None or r["doc_id"] % 2 == 0 for w in low(r["text"]))
    total = sum(seen.values())
    got = lm_scoring.score(clashing(docs, "score"), model, counts).collect()
    by = {}
    for r in rows:
        t = low(r["text"])
        by.setdefault(r["doc_id"], []).append((len(t), sum(seen[w] > 0 for w in t), sum(np.log10((seen[w] + 1) / (total + len(seen) + 1)) for w in t)))
    assert len(got) == len(rows)
    for r in got:
        assert r["train_tokens"] == total and r["score"] <= 0 and np.isfinite(r["score"])
        assert any((r["n_tokens"], r["n_known"]) == (n, k) and abs(r["base_score"] - b) < 1e-6 * max(1, abs(b)) for n, k, b in by[r["doc_id"]])


def test_lm_beats_the_base_on_held_out_texts(spark):
    r = lm_scoring.op5_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r["s"] > r["b"]


def test_lm_trees_are_whole():
    """The shares of all leaves sum to one: of a tree over words, and of each byte's tree."""
    weights = [float(i % 7 + 1) for i in range(300)]
    paths, tails, _ = lm_scoring.ordered_tree(weights, sum(weights) / 16)
    at = {}
    for leaf in range(300):
        steps = slice(paths.offset[leaf], paths.offset[leaf] + paths.length[leaf])
        at.setdefault(tuple(zip(paths.nodes[steps].tolist(), paths.bits[steps].tolist())), []).append(np.exp(tails[leaf]))
    assert len(at) > 16 and all(abs(sum(x) - 1) < 1e-9 for x in at.values())
    assert abs(sum(2.0 ** -len(path) for path in at) - 1) < 1e-12
    forest = lm_scoring.byte_forest(np.random.RandomState(1).random_sample((256, 256)))
    assert all(abs(sum(2.0 ** -forest.length[b * 256 : b * 256 + 256].astype(float)) - 1) < 1e-12 for b in (0, 32, 255))


def test_lm_without_training_texts(empty, hard):
    model, counts = lm_scoring.train(empty)
    assert all(np.isfinite(r["score"]) for r in lm_scoring.score(hard, model, counts).collect())


# 6


def test_quality_statistics_equal_brute_force(spark, hard):
    docs = hard.unionByName(table(spark, SF, "documents"))
    for r in quality_rules.text_statistics(clashing(docs, "n_words")).collect():
        t = r["text"] or ""
        w = words(t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        often = Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if words(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))


def test_quality_rules_learn_a_planted_rule(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(60)) + (" #" * 40 if i % 4 == 0 else ""), int(i % 4 != 0)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    judged, rules = quality_rules.judge(docs.select("doc_id", "text"), docs.select("doc_id", "quality"))
    assert rules and judged.where("kept <> (doc_id % 4 <> 0)").count() == 0


def test_quality_without_labels_keeps_what_the_base_keeps(spark, hard, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    judged, rules = quality_rules.judge(hard, none)
    assert not rules and judged.where("kept = base_failed").count() == 0
    assert quality_rules.judge(empty, none)[0].count() == 0


# 7


def test_mixing_meets_targets_and_nests(spark):
    docs = table(spark, SF, "documents")
    small, large = (mixing.mix(clashing(docs, "target"), budget=b).select("doc_id", "text", "source", "size", "source_size", "target", "taken") for b in (0.5, 1.5))
    for r in large.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most")).collect():
        assert abs(r["taken"] - r["target"]) <= r["most"]
    assert large.where("taken > 2 * size").count() == 0
    assert small.select("doc_id", F.col("taken").alias("t")).join(large, "doc_id").where("t > taken").count() == 0
    assert sorted(large.collect()) == sorted(mixing.mix(docs).select(large.columns).collect())


def test_mixing_deals_whole_copies_of_repeated_rows(spark):
    rows = [(1, "ten words are in this text and no more here", "en", "web", 1)] * 9 + [(2, "other", "en", "books", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    mixed = mixing.mix(docs)
    dealt = mixing.deal_copies(clashing(mixed, "copies"))
    assert dealt.columns == [*mixed.columns, "copies"] and dealt.count() == 10
    got = dealt.where("doc_id = 1").agg(F.sum("taken").alias("t"), F.sum(F.col("copies") * F.col("size")).alias("c"), F.max("copies").alias("most")).first()
    assert abs(got["c"] - got["t"]) <= 3 * 10 and got["most"] <= 2
    assert mixing.deal_copies(mixing.mix(docs.limit(0))).count() == 0


def test_mixing_hard_rows(hard, empty):
    got = mixing.mix(hard)
    assert got.count() == len(HARD) and got.where("size = 0 AND taken > 0").count() == 0
    assert mixing.mix(empty).count() == 0


# 8


def brute_top(rows, k):
    usable = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and abs(64 * float(x)) < np.inf for x in v)]
    out = []
    for q, (qi, qv) in enumerate(usable):
        if qi is not None and qi % 20 == 0:
            scored = sorted(((-sum(a * b for a, b in zip(qv, v)), i is None, i or 0) for c, (i, v) in enumerate(usable) if c != q and len(v) == len(qv)))[:k]
            out += [(qi, n + 1, None if none else i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, none, i) in enumerate(scored)]
    return sorted(map(str, out))


@pytest.mark.parametrize("blocks", [(8_192, 4_096), (7, 3)])
def test_top_k_equals_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "BLOCK_ROWS", blocks[0])
    monkeypatch.setattr(topk, "BLOCK_QUERIES", blocks[1])
    random = np.random.RandomState(3)
    rows = [(i, [float(x) for x in random.randn(6)]) for i in range(50)] + [(i, [0.5] * 6) for i in range(50, 70)]
    rows += [(80, None), (100, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (120, [float("nan")] * 6), (140, [1e300] + [1.0] * 5), (20, [0.1] * 6), (20, [0.1] * 6), (None, [0.5] * 6), (160, [0.0] * 6), (180, [1.0] * 3), (190, [2.0] * 3)]
    rows += [(200, [3e30] * 6), (201, [2e30] * 6), (202, [1e308] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = topk.exact_top_k(df, F.col("vec_id") % 20 == 0, k=5).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_top(rows, 5)
    assert topk.exact_top_k(df.limit(0), F.lit(True)).count() == 0


# 9


def test_license_scan_finds_changed_notices_only(spark, hard, empty):
    rows = [(1, "code\n# Licensed under the Apache License, Version 2.0\nmore"), (2, "released under the mit licence"), (3, license_scan.TEMPLATES["MIT"].upper() + " extra words"), (4, None), (5, ""), (6, "nothing of the kind")]
    got = {r["doc_id"]: r["best_license"] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id int, text string").withColumn("licenses", F.lit(1))).collect()}
    assert got == {1: "Apache-2.0 notice", 2: None, 3: "MIT", 4: None, 5: None, 6: None}
    assert license_scan.scan(hard).count() == len(HARD) and license_scan.scan(empty).count() == 0
    assert license_scan.scan(hard, {}).where("n_units > 0").count() == 0


# 10


def brute_components(rows, width):
    sets = [minhash.shingle_set(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        component = min(ids, default=None) if sets[i] else doc_id
        out.append((doc_id, len(sets[i]), component, doc_id == component))
    return sorted(map(str, out))


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_equal_brute_force(spark, hard, width):
    chain = [(1000 + i, " ".join([*WORDS[i % 3 :], *(f"t{k}" for k in range(i, i + 60))]), "en", "web", 1) for i in range(12)]
    docs = hard.unionByName(spark.createDataFrame(chain, SCHEMA)).unionByName(table(spark, SF, "documents").where("doc_id < 150").withColumn("doc_id", F.col("doc_id") + 5000))
    got = minhash.near_duplicates(clashing(docs, "cls", "n"), width=width)
    assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"])) for r in got.collect()) == brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], width)


@pytest.mark.parametrize(("small", "worth"), [(16, 4), (2, 0)])
def test_large_groups_of_near_copies_equal_brute_force(spark, monkeypatch, small, worth):
    """Copies of two versions of a text, each with changes of its own: most pairs are a little under the threshold."""
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "WORTH", worth)
    random = np.random.RandomState(5)
    base = [f"w{i}" for i in range(60)]
    other = base[:45] + [f"v{i}" for i in range(20)]
    rows = []
    for i in range(160):
        t = list(base if i % 2 else other)
        for _ in range(random.randint(0, 5)):
            at = random.randint(len(t))
            kind = random.randint(4)
            t[at : at + (kind != 1)] = [[f"x{i}"], ["shared"], [], [f"w{random.randint(60)}"]][kind]
        rows.append((i, " ".join(t[random.randint(4) :]), "en", "web", 1))
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), width=4)
    assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"])) for r in got.collect()) == brute_components([r[:2] for r in rows], 4)


def test_words_whose_polynomial_hashes_collide_are_not_linked(spark):
    thue = "a"
    for _ in range(11):
        thue += thue.translate(str.maketrans("ab", "ba"))
    flipped = thue.translate(str.maketrans("ab", "ba"))
    rows = [(i, f"{w} one two three {w}", "en", "web", 1) for i, w in enumerate((thue, flipped))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), width=4)
    assert {(r["doc_id"], r["component_id"]) for r in got.collect()} == {(0, 0), (1, 1)}


def test_one_of_each_picks_the_same_of_equal_texts(spark):
    rows = [(1, BASE, lang, source, 1) for lang, source in (("en", "web"), ("de", "books"), ("de", None))]
    for order in (rows, rows[::-1]):  # JSON leaves nulls out
        got = minhash.one_of_each(spark.createDataFrame(order, SCHEMA).repartition(2)).collect()
        assert [(r["lang"], r["source"]) for r in got] == [("de", None)]


def test_one_of_each_keeps_texts_without_words(hard, empty):
    got = minhash.one_of_each(hard)
    assert got.columns == hard.columns and got.where("doc_id IN (4, 5, 6)").count() == 3 and got.where("doc_id IN (1, 2)").count() == 1
    assert minhash.near_duplicates(empty).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r["node"]: r["comp"] for r in components.components(edges).collect()} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


# The pipeline.


def test_pipeline_stages(spark, hard, tmp_path):
    docs = hard.unionByName(table(spark, SF, "documents"))
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    held = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, held, f"file://{tmp_path}")
        if name != "BPE":
            assert out.columns == docs.columns
        path = f"file://{tmp_path}/{name.replace(' ', '-')}"
        out.write.parquet(path)
        before, held = held, spark.read.parquet(path)
        if name in ("language ID", "line dedup", "near dedup"):
            assert 0 < held.count() <= before.count()
    assert held.where("NOT same").count() == 0 and held.count() > 0
    kept = spark.read.parquet(f"file://{tmp_path}/near-dedup")
    assert minhash.near_duplicates(kept).where("NOT kept").count() == 0


def test_pipeline_of_an_empty_table(spark, empty, tmp_path):
    empty.write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
