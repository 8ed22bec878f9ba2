"""Providers are asked once: answers are in the journal before anything reads them."""

import os
import time
from collections import Counter

import pytest

from lexspark.operators import augment
from lexspark.sources import sinks


def counting(folder, crash=None, takes=0.0):
    """A provider that notes each item as it answers it, and when; the worker dies at ``crash`` for as long as there is
    a file of that name."""

    def provider(items):
        began = time.time()
        if crash and any(i["id"] == crash for i in items) and os.path.exists(f"{folder}/{crash}"):
            os._exit(1)
        time.sleep(takes)
        with open(f"{folder}/calls", "a") as f:
            f.write(f"{began} {time.time()} {','.join(i['id'] for i in items)}\n")
        return [{"id": i["id"], "augmented_description": i["description"].upper(), "keywords": ["asked"]} for i in items]

    return provider


def fallback(items):
    return [{"id": i["id"], "augmented_description": None, "keywords": ["fallback"]} for i in items]


def calls(folder):
    return [line.split() for line in open(f"{folder}/calls")]


def asked(folder):
    return Counter(i for c in calls(folder) for i in c[2].split(","))


def things(spark, n):
    return spark.createDataFrame([(f"k{i}", f"thing number {i}") for i in range(n)], "id string, description string").repartition(5)


def test_refresh_asks_once(spark, tmp_path):
    """A new cache and a longer one; comparing and sorting versions asks for nothing."""
    store = sinks.CacheStore(spark, f"file://{tmp_path}/store")
    for n in (100, 150):
        got = augment.refresh(store, things(spark, n), counting(tmp_path), fallback, batch_size=20, rounds=2).collect()
        assert {r["id"]: r["augmented_description"] for r in got} == {f"k{i}": f"THING NUMBER {i}" for i in range(n)}
        assert asked(tmp_path) == {f"k{i}": 1 for i in range(n)}
    augment.refresh(store, things(spark, 150), counting(tmp_path), fallback)
    assert sum(asked(tmp_path).values()) == 150 and store.answered().count() == 150
    assert max(len(c[2].split(",")) for c in calls(tmp_path)) == 20


def test_a_lost_worker_costs_its_batch_only(spark, tmp_path):
    """The job fails with a batch; what the others answered stays, and the rerun asks for the rest."""
    store = sinks.CacheStore(spark, f"file://{tmp_path}/store")
    (tmp_path / "k42").touch()
    provider = counting(tmp_path, crash="k42")
    with pytest.raises(Exception, match="k42|worker|crash|EOF|exited|failed"):
        augment.refresh(store, things(spark, 200), provider, fallback, batch_size=5, parallel=10)
    before = asked(tmp_path)
    assert store.versions() == [] and 0 < len(before) < 200 and "k42" not in before
    held = {r["id"] for r in store.journal().read(augment.ANSWER).select("id").collect()}
    assert held
    (tmp_path / "k42").unlink()
    got = augment.refresh(store, things(spark, 200), provider, fallback, batch_size=5, parallel=10)
    assert got.count() == 200
    again = {i for i, n in asked(tmp_path).items() if n > 1}
    assert not again & held and len(again) <= 10 * 5  # no more than ran as the job was ended


def test_no_more_calls_at_once_than_allowed(spark, tmp_path):
    items = things(spark, 60)
    journal = sinks.AnswerJournal(spark, f"file://{tmp_path}/journal")
    augment.ask_once(items, journal, counting(tmp_path, takes=0.2), fallback, batch_size=5, parallel=3, pause=0.1)
    spans = [(float(a), float(b)) for a, b, _ in calls(tmp_path)]
    assert len(spans) == 12
    assert max(sum(a <= t < b for a, b in spans) for t, _ in spans) <= 3


def test_journal_on_hard_rows(spark, tmp_path):
    journal = sinks.AnswerJournal(spark, f"file://{tmp_path}/journal")
    rows = spark.createDataFrame([("a", "x"), ("a", "x"), (None, "y"), ("b", None)], "id string, description string")
    plain = lambda items: [{"id": i["id"], "augmented_description": None, "keywords": None} for i in items]
    got = augment.ask_once(rows, journal, plain, fallback)
    assert sorted(r["id"] for r in got.collect()) == ["a", "b"]
    assert augment.ask_once(rows.limit(0), journal, plain, fallback).collect() == []
    assert journal.read(augment.ANSWER).count() == 2
