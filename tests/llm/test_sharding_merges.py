"""How often compaction writes a row."""

from lexspark.llm import sharding


def written(store):
    """Bytes of all data files, of merged ones and of those they were made from."""
    versions = [store.shards(v) for v in store.versions()]
    return sum({s.path: s.bytes for shards in versions for s in shards}.values())


def test_full_tiers_and_the_tier_they_fill_are_one_merge(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/t", target_bytes=1 << 40, fan_in=4)
    shards = lambda *sizes: [sharding.Shard(f"p{i}", n, 1) for i, n in enumerate(sizes)]

    def full(*sizes):
        tiers = {}
        for s in shards(*sizes):
            tiers.setdefault(store.tier(s), []).append(s)
        return sorted(s.bytes for s in store._full(tiers))

    assert full(20, 20, 20) == []
    assert full(20, 20, 20, 20, 70) == [20, 20, 20, 20]
    assert full(20, 20, 20, 20, 70, 70, 70) == [20, 20, 20, 20, 70, 70, 70]  # would be four in the next tier
    assert full(*[60] * 4, *[70] * 4) == [60] * 4 + [70] * 4  # one arrival on both sides of a tier's border
    assert full(*[20] * 4, *[70] * 3, *[300] * 3) == [20] * 4 + [70] * 3 + [300] * 3


def test_arrivals_are_written_less_than_three_times(spark, tmp_path):
    """Eight arrivals of many small shards: once as they come, once merged by arrival or, the last, with all others."""
    store = sharding.ShardStore(spark, f"file://{tmp_path}/t", target_bytes=1 << 30, fan_in=8)
    rows = spark.range(0, 80_000, 1, 16).selectExpr("id", "sha2(cast(id as string), 512) AS text", "id % 8 AS arrival")
    store.append(rows, arrival="arrival")
    assert store.read().count() == 80_000 and store.read().distinct().count() == 80_000
    assert written(store) < 3 * sum(s.bytes for s in store.shards()) and len(store.shards()) == 1
    assert [store.read(v).count() for v in sorted(store.versions())][-1] == 80_000 and min(store.versions()) == 1
