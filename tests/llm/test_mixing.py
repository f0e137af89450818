import hashlib
import re
from collections import defaultdict

import pytest
from edges import documents, rows

from panelweave.llm import mixing


def brute(data, weights=(5, 2, 1)):
    """(doc_id, size, source_size, target, taken) from plain Python."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in data]
    total = defaultdict(int)
    for r, s in zip(data, size, strict=True):
        total[r[3]] += s
    names = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [None] * (None in total)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    budget = 1.5 * sum(size)
    while open_:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * total[s]}
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: 2.0 * total[s] for s in full}
        open_ -= full
    queues, out = defaultdict(int), []
    order = sorted(zip(data, size, strict=True), key=lambda x: (hashlib.md5(("" if x[0][0] is None else str(x[0][0])).encode()).hexdigest(), x[0][0] is not None, x[0][0] or 0, x[1]))
    for r, s in order:
        goal, start = int(target[r[3]]), queues[r[3]]
        queues[r[3]] += s
        taken = sum(max(0, min(s, goal - start - copy * total[r[3]])) for copy in range(2))
        out.append((r[0], s, total[r[3]], pytest.approx(target[r[3]]), taken))
    return sorted(out, key=lambda r: (str(r[0]), r[1]))


def found(frame, **how):
    picked = mixing.mix(frame, **how).select("doc_id", "size", "source_size", "target", "taken").collect()
    return sorted(map(tuple, picked), key=lambda r: (str(r[0]), r[1]))


def test_matches_brute_force_on_edge_rows(spark):
    assert found(documents(spark)) == brute(rows())


def test_matches_brute_force_with_a_hot_source(spark):
    data = [(i, "w " * (i * 37 % 50), "en", "hot" if i % 3 == 0 else f"s{i % 20}") for i in range(2000)]
    frame = spark.createDataFrame(data, "doc_id long, text string, lang string, source string").repartition(5)
    got = found(frame)
    assert got == brute(data)
    taken, targets = defaultdict(int), {}
    by_id = {r[0]: r for r in got}
    for d in data:
        taken[d[3]] += by_id[d[0]][4]
        targets[d[3]] = by_id[d[0]][3]
    assert all(abs(taken[s] - targets[s]) <= 1 for s in targets)


def test_mixed_rows_follow_virtual_time(spark):
    data = [(i, "w " * 10, "en", "a" if i < 100 else "b") for i in range(200)]
    frame = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    out = [r.source for r in mixing.mixed(frame).collect()]
    assert len(out) == 300 and out.count("a") == 200 and out.count("b") == 100
    # Two of `a` for each of `b`, all along.
    assert all(abs(out[:n].count("a") - 2 * n / 3) <= 3 for n in range(1, 301))


def test_empty_table_and_columns(spark):
    empty = documents(spark, [])
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed(empty).count() == 0
    assert mixing.mixed(documents(spark)).columns == empty.columns
