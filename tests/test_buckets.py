"""Merges by bucket: what they touch, what they leave, and two writers at once."""

import pytest

from lexspark.sources.buckets import BucketTable

ROWS = "id string, said string"


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), ROWS)


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    t = BucketTable(spark, f"file://{tmp_path}/t", buckets=8)
    assert t.read() is None and t.lookup(frame(spark)) is None
    assert t.merge(frame(spark)) == 1 and t.read().collect() == []
    want = {f"k{i}": f"a{i}" for i in range(200)}
    assert t.merge(frame(spark, *want.items())) == 2
    first = t.manifest()
    assert len(first.folders) == 8 and dict(map(tuple, t.read().collect())) == want
    assert t.merge(frame(spark, ("k7", None), ("new", "b"))) == 3
    second = t.manifest()
    changed = [b for b in first.folders if first.folders[b] != second.folders[b]]
    assert 1 <= len(changed) <= 2
    assert sorted(map(tuple, t.read().collect()), key=str) == sorted((want | {"k7": None, "new": "b"}).items(), key=str)
    assert t.merge(frame(spark)) == 3
    assert dict(map(tuple, t.read(2).collect())) == want
    asked = frame(spark, ("k7", ""), ("k8", ""), ("k8", ""), ("none", ""))
    assert sorted(map(tuple, t.lookup(asked).collect()), key=str) == [("k7", None), ("k8", "a8")]
    t.vacuum(keep=1)
    assert t.versions() == [3] and t.read().count() == 201


def test_the_second_writer_merges_again(spark, tmp_path):
    a, b = (BucketTable(spark, f"file://{tmp_path}/t", buckets=4) for _ in range(2))
    a.merge(frame(spark, ("x", "0"), ("y", "0")))
    rewrite, calls = b._rewrite, []

    def late(*args):
        out = rewrite(*args)
        if not calls:
            a.merge(frame(spark, ("x", "a"), ("z", "a")))
        calls.append(1)
        return out

    b._rewrite = late
    assert b.merge(frame(spark, ("x", "b"))) == 3 and len(calls) == 2
    assert sorted(map(tuple, b.read().collect())) == [("x", "b"), ("y", "0"), ("z", "a")]


def test_other_columns_are_refused(spark, tmp_path):
    t = BucketTable(spark, f"file://{tmp_path}/t")
    t.merge(frame(spark, ("x", "0")))
    with pytest.raises(ValueError, match="columns"):
        t.merge(frame(spark, ("x", "0")).withColumnRenamed("said", "says"))
