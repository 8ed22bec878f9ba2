"""Versions from before a merge, until they are vacuumed."""

import pytest

from lexspark.llm import sharding


def test_versions_before_a_merge_can_be_read(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/t", fan_in=2)
    for i in range(4):
        store.append(spark.range(10 * i, 10 * i + 10).coalesce(1))
    counts = [store.read(v).count() for v in sorted(store.versions())]
    assert counts == sorted(counts) and counts[0] == 10 and counts[-1] == 40 and set(counts) == {10, 20, 30, 40}
    last = store.manifest()["version"]
    with pytest.raises(ValueError, match="keep"):
        store.vacuum(keep=0)
    store.vacuum(keep=2)
    assert sorted(store.versions()) == [last - 1, last]
    assert store.read(last - 1).count() == 40 and store.read().count() == 40
