"""What of the differences from a hub is compared at all."""

from lexspark.llm import minhash
from lexspark.session import Scratch

SCHEMA = "cls binary, comp binary, hub binary, n long, hub_n long, diff array<long>"


def difference(name, comp, *elements):
    return bytearray(name.encode()), bytearray(comp.encode()), bytearray(b"hub"), 100, 100, list(elements)


def test_elements_of_linked_classes_alone_are_not_compared(spark):
    """A large group that is linked to its hub, and two classes that are not: only what these share is compared."""
    linked = [difference(f"in{i}", "hub", 1, 2, 3, 1000 + i) for i in range(300)]
    far = list(range(100, 130))
    out = [difference("out1", "out1", *far, *range(5000, 5005)), difference("out2", "out2", *far, *range(6000, 6005))]
    got = minhash._shared_elements(spark.createDataFrame(linked + out, SCHEMA), 80, Scratch(spark)).collect()
    assert {bytes(r["cls"]) for r in got} == {b"out1", b"out2"} and sorted(r["e"] for r in got) == sorted(2 * far)
    pairs = minhash._by_difference(spark.createDataFrame(linked + out, SCHEMA), 80, Scratch(spark)).collect()
    assert [(bytes(r["a"]), bytes(r["b"])) for r in pairs] == [(b"out1", b"out2")]


def test_a_large_group_costs_rows_in_proportion(spark):
    """Copies that each lack other parts of the hub and have much of their own: none has enough left to share."""
    def rows(k):
        group = [difference(f"c{i}", f"c{i}", *range(i % 7, i % 7 + 6), *range(1000 * i, 1000 * i + 35)) for i in range(1, k + 1)]
        return minhash._shared_elements(spark.createDataFrame(group, SCHEMA), 80, Scratch(spark)).count()

    assert rows(400) == 0

    def some(k):  # enough is shared by all
        group = [difference(f"c{i}", f"c{i}", *range(i % 7, i % 7 + 30), 1000 * i) for i in range(1, k + 1)]
        return minhash._shared_elements(spark.createDataFrame(group, SCHEMA), 80, Scratch(spark)).count()

    assert some(70) == 70 * 30 and some(280) == 280 * 30
