"""Verified links between rows that share a bucket, without ever listing the pairs of a group.

Buckets only propose: nodes that share one form candidate groups (connected components over stars from each
bucket's smallest node). A group up to `BLOCK` in weight is checked in one task; a larger one is cut into blocks,
near nodes together, and every pair of blocks that shares a bucket is its own task. So each pair is met once,
each node travels once per pair of blocks, and a hot group is spread over many tasks. Tasks return counts of
links and a spanning forest, at most one edge per node, never the pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.graph import components
from panelweave.llm.storage import remove, written
from panelweave.operators.skew import attach_groups

# Total weight of a block; a node weighs 1 plus its size in units of the caller.
BLOCK = 1024


def block_tasks(buckets: DataFrame) -> DataFrame:
    """Where each node is checked: (node, task, left) from `buckets` (bucket, node, weight), as a written table.

    Nodes that share no bucket with another are left out. Within a task, left nodes are compared with each
    other if the task has no right node, else with the right ones.
    """
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("first")).where("n > 1")
    members = written(attach_groups(buckets, shared, ["bucket"], "inner").select("bucket", "node", "weight", "first"), "members")
    groups = components(members.select(F.col("node").alias("a"), F.col("first").alias("b")))
    nodes = members.groupBy("node").agg(F.min("first").alias("anchor"), F.first("weight").alias("weight")).join(groups, "node")
    nodes = written(nodes, "nodes")
    sizes = nodes.groupBy("component").agg(F.sum("weight").alias("size"))
    anchors = nodes.groupBy("anchor").agg(F.sum("weight").alias("anchor_size"))
    placed = attach_groups(attach_groups(nodes, sizes, ["component"]), anchors, ["anchor"])
    bins = F.ceil(F.col("size") / BLOCK)
    salts = F.ceil(F.col("anchor_size") / BLOCK)
    block = F.struct(F.pmod(F.xxhash64("anchor"), bins).alias("bin"), F.pmod(F.xxhash64("node"), salts).alias("salt"))
    placed = written(placed.select("node", "component", F.when(bins > 1, block).alias("block")), "blocks")
    alone = placed.where("block IS NULL").select("node", F.struct("component", "block", F.col("block").alias("other")).alias("task"), F.lit(True).alias("left"))
    large = placed.where("block IS NOT NULL")
    spans = members.select("bucket", "node").join(large, "node").select("bucket", "component", "block").distinct()
    pairs = spans.join(spans.select("bucket", F.col("block").alias("other")), "bucket").where("block <= other")
    pairs = written(pairs.select("component", "block", "other").distinct(), "pairs")
    task = F.struct("component", "block", "other").alias("task")
    left = large.join(pairs, ["component", "block"]).select("node", task, F.lit(True).alias("left"))
    mirrored = pairs.where("block <> other").select("component", F.col("other").alias("block"), F.col("block").alias("first"))
    right_task = F.struct("component", F.col("first").alias("block"), F.col("block").alias("other")).alias("task")
    right = large.join(mirrored, ["component", "block"]).select("node", right_task, F.lit(False).alias("left"))
    tasks = written(alone.unionByName(left).unionByName(right), "tasks")
    for used in (members, nodes, placed, pairs):
        remove(used)
    return tasks


def verified_links(tasks: DataFrame, similar: Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]) -> DataFrame:
    """Check all tasks: (node, n_links, root) for nodes with links, one row per node and task.

    `tasks` has node, task, left, copies and the columns that `similar` needs; `similar(a, b)` is the boolean
    matrix of links between the rows of two frames. A linked node counts with its `copies`.
    """
    node_type = tasks.schema["node"].dataType.simpleString()

    def check(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = rows[rows["left"]], rows[~rows["left"]]
        within = not len(right)
        other = left if within else right
        links = similar(left, other)
        if within:
            np.fill_diagonal(links, False)
        nodes = np.concatenate((left["node"].to_numpy(object), [] if within else right["node"].to_numpy(object)))
        counts = links @ other["copies"].to_numpy(np.int64)
        if not within:
            counts = np.concatenate((counts, links.T @ left["copies"].to_numpy(np.int64)))
        a, b = np.nonzero(links)
        roots = _roots(len(nodes), a, b if within else b + len(left), nodes)
        found = counts > 0
        return pd.DataFrame({"node": nodes[found], "n_links": counts[found], "root": nodes[roots[found]]})

    return tasks.groupBy("task").applyInPandas(check, f"node {node_type}, n_links long, root {node_type}")


def _roots(size: int, a: np.ndarray, b: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """For each place the place of the smallest node it is connected to."""
    order = np.empty(size, np.int64)
    by_node = np.argsort(nodes, kind="stable")
    order[by_node] = np.arange(size)
    label = np.arange(size)
    x, y = order[a], order[b]
    while True:
        least = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        label = label[label]
        if (label == before).all():
            break
    return by_node[label[order]]


def linked_classes(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, n_links) and (node, component) from the rows of `verified_links`, written once."""
    links = written(links, "links")
    return links.groupBy("node").agg(F.sum("n_links").alias("n_links")), components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
