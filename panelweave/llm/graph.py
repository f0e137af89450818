"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.storage import remove, written
from panelweave.operators.skew import attach_groups

MAX_ROUNDS = 200


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b); the component is its smallest node.

    Each round rewires every edge towards the smallest neighbour and is written to the shared folder, so
    nothing about the graph but a row count and a checksum reaches the driver. Node columns may have any
    orderable type; self-loops are kept as components of one, null nodes are ignored.
    """
    edges = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")
    loops = edges.where("a = b").select("a")
    now = written(_directed(edges.where("a <> b")), "edges")
    before = _checksum(now)
    for _ in range(MAX_ROUNDS):
        following = written(_small_star(_large_star(now)), "edges")
        after = _checksum(following)
        remove(now)
        now = following
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    members = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    alone = loops.select(F.col("a").alias("node"), F.col("a").alias("component"))
    return members.unionByName(roots).unionByName(alone).groupBy("node").agg(F.min("component").alias("component"))


def _directed(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest neighbour (or the node itself)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
    larger = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return attach_groups(larger, least, ["a"], "inner").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    rest = attach_groups(edges, least, ["a"], "inner").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return rest.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
