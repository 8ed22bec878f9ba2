"""Ratcliff/Obershelp similarity of short texts inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _longest_block(x: Column, y: Column) -> Column:
    """struct(k, e): the longest substring of x that y has too ends at place e of x and has k characters; of several
    the one that ends first. With each further character of x it grows by one at most."""
    start = F.struct(F.lit(0).alias("k"), F.lit(0).alias("e"))
    longer = lambda s, e: F.instr(y, F.substring(x, e - s["k"], s["k"] + 1)) > 0
    return F.aggregate(F.sequence(F.lit(1), F.length(x)), start, lambda s, e: F.when(longer(s, e), F.struct((s["k"] + 1).alias("k"), e.alias("e"))).otherwise(s))


def matched(a: Column, b: Column) -> Column:
    """How many characters match: those of the longest common block, the first in a and then the first in b, and those
    matched in the same way left and right of it. The order of the two matters."""
    none = F.array().cast("array<struct<x:string,y:string>>")
    part = lambda x, y: F.struct(x.alias("x"), y.alias("y"))

    def around(p: Column) -> Column:
        k, e = p["c"]["k"], p["c"]["e"]
        j = F.instr(p["y"], F.substring(p["x"], e - k + 1, k))
        left = part(F.substring(p["x"], F.lit(1), e - k), F.substring(p["y"], F.lit(1), j - 1))
        right = part(F.substring(p["x"], e + 1, F.length(p["x"])), F.substring(p["y"], j + k, F.length(p["y"])))
        return F.when(k > 0, F.array(left, right)).otherwise(none)

    def step(s: Column, _: Column) -> Column:
        blocks = F.transform(s["parts"], lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), _longest_block(p["x"], p["y"]).alias("c")))
        # An array of one, so that the blocks are found once.
        onward = F.transform(
            F.array(blocks),
            lambda f: F.struct(
                F.filter(F.flatten(F.transform(f, around)), lambda p: (p["x"] != "") & (p["y"] != "")).alias("parts"),
                F.aggregate(f, s["n"], lambda n, p: n + p["c"]["k"]).alias("n"),
            ),
        )
        return F.when(F.size(s["parts"]) > 0, F.element_at(onward, 1)).otherwise(s)

    start = F.struct(F.array(part(a, b)).alias("parts"), F.lit(0).alias("n"))
    least = F.least(F.length(a), F.length(b))
    return F.when(least == 0, 0).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(least, F.lit(1))), start, step)["n"])


def ratio(a: Column, b: Column) -> Column:
    """Twice the matched characters by all characters; 1 for two empty texts, null if one is null. Texts of any length are
    compared in full, without leaving out characters that are frequent in long ones."""
    size = F.length(a) + F.length(b)
    return F.when(a == b, F.lit(1.0)).when(size.isNull(), F.lit(None)).otherwise(2.0 * matched(a, b) / size)


def at_most(a: Column, b: Column) -> Column:
    """A bound of the ratio: letters that only one of the two has match nothing."""
    x, y = F.split(a, ""), F.split(b, "")
    one, other = F.length(a) - F.size(F.array_except(x, y)), F.length(b) - F.size(F.array_except(y, x))
    return F.when(a == b, 1.0).otherwise(2.0 * F.greatest(F.lit(0), F.least(one, other)) / F.greatest(F.lit(1), F.length(a) + F.length(b)))
