"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import drop, stored


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the least node it reaches. Edges with a null or of a node to itself are ignored.

    Rounds go on until nothing changes; their number grows with the logarithm of a component's size. Edges stay in the cluster: each
    round's edges are written to the shared folder and those of the round before removed. Every star keeps one edge per node, and the rows of its
    centre pass a sorted join one by one, so that a star of any size needs no more memory than a small one.
    """
    now = stored(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-given")
    before = None
    while (state := _state(now)) != before:
        before, last = state, now
        now = stored(_small(_large(last)), f"{name}-round")
        drop(last)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.expr("cast(b as decimal(38, 0))"))).first())


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the least of its neighbourhood. Edges (a, b) have a > b, here and below."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).where("m < n")
    # A node without a lesser neighbour keeps its larger ones.
    moved = edges.select(F.col("b").alias("n"), F.col("a").alias("x")).join(least, "n", "left")
    return moved.select(F.col("x").alias("a"), F.coalesce("m", "n").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, move to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
