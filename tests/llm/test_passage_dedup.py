"""Passages of few lines, planted between other lines, against brute force over all pairs and chunks."""

import hashlib

import pytest

import corpus_pipeline
from lexspark.llm import line_dedup, passage_dedup
from lexspark.llm.common import table
from tests.conftest import SF


def planted(n):
    return [f"line {n}.{k} " + " ".join(f"word{n}x{k}x{j}" for j in range(60)) for k in range(n)]


def units(lines):
    """Pairs of neighbours that aren't blank, and chunks of two lines or more that aren't all blank."""
    full = [i for i, x in enumerate(lines) if x.strip()]
    chunks = [(a, b - 1) for a, b in line_dedup.chunk_lines(lines) if b - a > 1 and any(x.strip() for x in lines[a:b])]
    return {*zip(full, full[1:]), *chunks}


def brute(rows):
    """What stays of each text, in the order of the rows."""
    key = lambda i, t: hashlib.md5(("\x00" if i is None else str(i)).encode() + b"\x1f" + ("\x00" if t is None else t).encode()).digest()
    first = {}
    for none, _, k, t in sorted({(i is None, i or 0, key(i, t), t) for i, t in rows if t}):
        lines = t.split("\n")
        for a, e in sorted(units(lines)):
            first.setdefault("\n".join(lines[a : e + 1]), (k, a, e))
    out = []
    for i, t in rows:
        lines, drop = (t or "").split("\n"), set()
        for a, e in units(lines):
            k, b, c = first["\n".join(lines[a : e + 1])]
            same = k == key(i, t)
            if not (same and a == b):
                drop |= set(range(a, e + 1)) - (set(range(b, c + 1)) if same else set())
        out.append((i, t if not drop else "\n".join(x for j, x in enumerate(lines) if j not in drop)))
    return sorted(map(str, out))


@pytest.mark.parametrize("run", [lambda s, d: passage_dedup.dedup_passages(d), lambda s, d: corpus_pipeline.dedup_lines(s, d, SF)])
def test_short_passages_go_whole(spark, run):
    rows = []
    for n in range(2, 7):
        body = planted(n)
        for k in range(10):
            around = [f"own {n}.{k}.{side}" for side in "abcd"]
            middle = body if n != 4 else [*body[:2], "", *body[2:]]
            rows.append((100 * n + k, "\n".join([*around[: k % 3 + 1], *middle, *around[3:]]), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").repartition(4)
    got = {r["doc_id"]: r["text"] for r in run(spark, docs).collect()}
    for i, t, _ in rows:
        if i % 100 == 0:
            assert got[i] == t
        else:
            assert got[i] == "\n".join(x for x in t.split("\n") if x.startswith("own"))


def test_passages_equal_brute_force(spark):
    rows = [(1, "a\na\na\na"), (2, "a\n\na\nb"), (3, "x\na\n\na\nb\ny"), (3, "x\na\n\na\nb\ny"), (4, None), (5, ""), (6, "\n \n"), (None, "q\nr"), (None, "q\nr\ns"), (7, "q\nr"), (8, "solo"), (9, "solo\nelse"), (10, "r\nsolo\nend")]
    rows += [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = passage_dedup.dedup_passages(docs)
    assert sorted(str((r["doc_id"], r["text"])) for r in got.collect()) == brute(rows)
    assert passage_dedup.dedup_passages(docs.limit(0)).count() == 0


def test_chunks_go_as_in_line_dedup(spark):
    """Whatever the chunks alone remove goes here too."""
    docs = table(spark, SF, "documents").select("doc_id", "text")
    chunks, units_ = (f(docs).groupBy("doc_id").max("n_removed").withColumnRenamed("max(n_removed)", n) for f, n in ((line_dedup.dedup_lines, "c"), (passage_dedup.dedup_passages, "u")))
    both = chunks.join(units_, "doc_id").collect()
    assert sum(r["c"] for r in both) > 0 and all(r["u"] >= r["c"] for r in both)
