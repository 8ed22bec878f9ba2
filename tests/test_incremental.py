"""Headings across many batches: the same rows as at once, with few runs to read."""

import random

import pytest

from lexspark.operators import hierarchy
from lexspark.streaming import incremental

COLUMNS = ["pdf", "page", "pos", "code", "description"]


def pages(n):
    """Pages of two files with headings of four, six and eight digits that come again with other words, and rows below."""
    rng = random.Random(3)
    out = []
    for page in range(n):
        for pdf in ("a", "b"):
            for pos in range(5):
                code = f"010{rng.randrange(1, 3)}" + "".join(f"{rng.randrange(1, 3)}0" for _ in range(rng.randrange(0, 4)))
                out.append((pdf, page, pos, code, f"heading words {page} {pdf} {pos}"))
    return out


def plain(df):
    return sorted(map(tuple, df.select("pdf", "page", "pos", "code", "description").collect()))


@pytest.mark.parametrize("last_runs_again", [False, True])
def test_tiers_give_the_rows_of_one_run(spark, tmp_path, monkeypatch, last_runs_again):
    monkeypatch.setattr(incremental, "FAN", 2)
    sink, rows, n = f"file://{tmp_path}/out", pages(9), 9
    made = spark.createDataFrame(rows, incremental.ROWS)
    most = 0
    for batch in range(n):
        most = max(most, len(incremental.runs_before(spark, sink, batch)))
        for _ in range(1 + (last_runs_again and batch in (3, 4, 7))):
            incremental.inherit_batch(made.where(made.page == batch), batch, sink)
    assert plain(incremental.read_rows(spark, sink)) == plain(hierarchy.inherit(made))
    # Before batch 9 there are runs of 8 and of 1.
    assert most <= 3 and len(incremental.runs_before(spark, sink, 9)) == 2


def test_numbers_that_never_ran_and_empty_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "FAN", 2)
    sink, made = f"file://{tmp_path}/out", spark.createDataFrame(pages(4), incremental.ROWS)
    for batch, page in ((1, 0), (2, None), (5, 1), (6, 2), (8, 3)):
        incremental.inherit_batch(made.where(made.page == page if page is not None else "false"), batch, sink)
    assert plain(incremental.read_rows(spark, sink)) == plain(hierarchy.inherit(made))
