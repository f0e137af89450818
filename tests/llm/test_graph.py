import random

from pyspark.sql import functions as F

from panelweave.llm import linking
from panelweave.llm.graph import components


def brute(edges):
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {x: root(x) for x in parent}


def found(spark, edges):
    return {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}


def test_random_graphs_chains_and_stars(spark):
    draw = random.Random(3)
    scattered = [(draw.randrange(400), draw.randrange(400)) for _ in range(300)]
    chain = [(1000 + i, 1001 + i) for i in range(120)]
    star = [(5000, 5001 + i) for i in range(300)]
    edges = scattered + chain + star + [(7, 7)]
    draw.shuffle(edges)
    assert found(spark, edges) == brute(edges)


def test_no_edges_and_nulls(spark):
    assert found(spark, []) == {}
    assert found(spark, [(1, None), (None, 2), (3, 3)]) == {3: 3}


def test_large_groups_are_cut_into_blocks_that_meet_every_pair_once(spark, monkeypatch):
    monkeypatch.setattr(linking, "BLOCK", 20)
    draw = random.Random(8)
    sets = {i: {draw.randrange(12) for _ in range(2)} for i in range(150)}
    rows = [(b, i, 1) for i, s in sets.items() for b in s]
    tasks = linking.block_tasks(spark.createDataFrame(rows, "bucket long, node long, weight long"))
    groups = {}
    for r in tasks.collect():
        groups.setdefault(str(r.task), ([], []))[0 if r.left else 1].append(r.node)
    assert len(groups) > 5
    met = {}
    for left, right in groups.values():
        pairs = [(a, b) for a in left for b in right] if right else [(a, b) for a in left for b in left if a < b]
        for a, b in pairs:
            met[tuple(sorted((a, b)))] = met.get(tuple(sorted((a, b))), 0) + 1
    assert max(met.values()) == 1
    assert {(a, b) for a in sets for b in sets if a < b and sets[a] & sets[b]} <= set(met)


def test_blocks_give_the_links_of_one_block(spark, monkeypatch):
    rows = [(i % 2, i, 1) for i in range(90)]

    def links():
        buckets = spark.createDataFrame(rows, "bucket long, node long, weight long")
        tasks = linking.block_tasks(buckets).withColumn("copies", (F.col("node") % 3 + 1).cast("long"))
        near = lambda a, b: abs(a["node"].to_numpy()[:, None] - b["node"].to_numpy()) == 2
        counts, groups = linking.linked_classes(linking.verified_links(tasks, near))
        return sorted(map(tuple, counts.collect())), sorted(map(tuple, groups.collect()))

    whole = links()
    monkeypatch.setattr(linking, "BLOCK", 16)
    assert links() == whole
    assert whole[1] == [(i, i % 2) for i in range(90)]
