"""Connected components by contraction: every node points to its least neighbour, edges are relabelled, repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.session import Scratch


def components(edges: DataFrame) -> DataFrame:
    """``edges``: (a, b). Returns (node, comp) for every node of an edge; nodes of one component have one comp.

    A round costs a few joins of edges and nodes. Each component at least halves: a node that stays is the least
    neighbour of another. Nothing is collected; joins have single-row sides, so Spark can split a hub's edges."""
    held = Scratch(edges.sparkSession)
    e = held.table(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where(F.col("a") != F.col("b")).distinct(), "cc-edges")
    labels = None
    while True:
        step = held.table(e.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")).withColumnRenamed("a", "node"), "cc-step")
        for _ in range(2):  # follow the pointers: chains shrink faster
            onward = step.select(F.col("node").alias("m"), F.col("m").alias("m2"))
            step = held.table(step.join(onward, "m").select("node", F.col("m2").alias("m")), "cc-step")
        if labels is None:
            labels = step.select("node", F.col("m").alias("comp"))
            kept = step
        else:
            labels = kept = held.table(labels.join(step.select(F.col("node").alias("comp"), "m"), "comp", "left").select("node", F.coalesce("m", "comp").alias("comp")), "cc-labels")
        of_a, of_b = step.select(F.col("node").alias("a"), F.col("m").alias("ma")), step.select(F.col("node").alias("b"), F.col("m").alias("mb"))
        half = held.table(e.join(of_a, "a").select("ma", "b"), "cc-half")
        e = held.table(half.join(of_b, "b").where(F.col("ma") != F.col("mb")).select(F.col("ma").alias("a"), F.col("mb").alias("b")).distinct(), "cc-edges")
        held.keep(kept, e)
        if e.isEmpty():
            held.keep(kept)
            return labels
