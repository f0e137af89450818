import hashlib
import math

import numpy as np
import pytest

from panelweave.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, components string, code int, error string, row int"


def brute(data, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in data if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    size = max(1, -(-max(len(v) for _, v, _ in kept) // parts))
    kept = [(i, [max(-(2**24), min(2**24, x)) for x in v] + [0] * (size * parts - len(v)), label) for i, v, label in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p * size : (p + 1) * size] for r in first] for p in range(parts)]

    def nearest(part, p):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry, strict=True)), e) for e, entry in enumerate(books[p]))

    assign = lambda: [[nearest(v[p * size : (p + 1) * size], p) for p in range(parts)] for _, v, _ in kept]
    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(first)):
                mine = [v[p * size : (p + 1) * size] for (_, v, _), f in zip(kept, found, strict=True) if f[p][1] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = assign()
    errors = [sum(d for d, _ in f) for f in found]
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    by_label = {}
    for (_, _, label), error in zip(kept, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + error
    return sorted(((i, "".join(f"{e:02x}" for _, e in f), error, by_label[label], digest) for (i, _, label), f, error in zip(kept, found, errors, strict=True)), key=str)


def coded(spark, data, cut=3, **how):
    frame = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in data], SCHEMA)
    return sorted(map(tuple, vector_codes.compress(frame.repartition(cut) if data else frame, **how).collect()), key=str)


def as_floats(values):
    return [None if x is None else float(np.float32(x)) for x in values]


def vectors(count, size, seed=0, spread=1.0):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(12, size))
    return [(i, as_floats(centres[i % 12] + spread * draw.normal(size=size)), i % 5 if i % 7 else None) for i in range(count)]


@pytest.mark.parametrize("size", [8, 64])
def test_matches_brute_force(spark, size):
    data = vectors(150, size, spread=0.3)
    assert coded(spark, data) == brute(data)


def test_ties_and_unused_entries(spark):
    # Few distinct values: entries repeat, so some are never nearest and distances tie.
    draw = np.random.default_rng(3)
    data = [(i, [float(x) for x in draw.integers(0, 2, 16) / 4096], 1) for i in range(80)]
    assert coded(spark, data) == brute(data)


def test_edge_rows(spark):
    base = as_floats(np.random.default_rng(2).normal(size=16))
    data = [
        (5, base, 1), (5, base, 1), (5, base[::-1], None), (None, base, None), (2, None, 1), (3, [None, *base[1:]], 1), (4, [float("nan"), *base[1:]], 1),
        (6, [float("-inf"), *base[1:]], 1), (7, [], 2), (8, base[:5], 2), (9, [1e30, -1e30, *base[2:]], 3), (10, [0.0] * 16, 3), (11, base + [0.5], None),
    ]
    data = [(i, None if v is None else as_floats(v), label) for i, v, label in data]
    assert coded(spark, data) == brute(data)
    assert coded(spark, data, entries=3, rounds=2, parts=4) == brute(data, entries=3, rounds=2, parts=4)


def test_empty_and_unusable_tables(spark):
    assert coded(spark, []) == coded(spark, [(1, None, None), (2, [None], 1)]) == []
    assert coded(spark, [(1, [], None)]) == brute([(1, [], None)])


def test_one_label_and_partitions(spark):
    data = [(i, v, 1) for i, v, _ in vectors(60, 24, seed=4)]
    assert coded(spark, data, cut=1) == coded(spark, data, cut=7) == brute(data)


@pytest.mark.parametrize("kind", ["spread", "grid", "equal", "far"])
def test_tree_finds_the_nearest_entries_and_rules_out_others(kind):
    draw = np.random.default_rng(7)
    entries = {
        "spread": draw.integers(-5000, 5000, (256, 8)), "grid": draw.integers(0, 2, (64, 8)),
        "equal": np.ones((16, 8), np.int64), "far": draw.integers(-(2**24), 2**24, (100, 8)),
    }[kind].astype(np.int64)
    queries = np.concatenate((entries[draw.integers(0, len(entries), 500)] + draw.integers(-1, 2, (500, 8)), draw.integers(-6000, 6000, (500, 8))))
    tree = vector_codes.Gnat(entries)
    index, square = tree.nearest(queries)
    all_squares = ((queries[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (index == all_squares.argmin(axis=1)).all() and (square == all_squares.min(axis=1)).all()
    if kind in ("spread", "far"):
        assert tree.compared < 0.7 * all_squares.size
