import numpy as np
import pyarrow as pa
import pytest

from panelweave.llm import vector_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, kept boolean, node string"


def near_pairs(count, size, cosine, seed=0):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(count, size))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = draw.normal(size=(count, size))
    y -= (y * x).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    return x, cosine * x + np.sqrt(1 - cosine**2) * y


@pytest.mark.parametrize("size", [16, 64, 300])
@pytest.mark.parametrize("rows", [10_000, 10**8])
def test_tables_reach_the_recall(size, rows):
    tables, hashes = vector_dedup.choose_tables(rows, size)
    a, b = near_pairs(400, size, 0.98)
    salt = np.zeros(400, np.uint64)
    # Each table is met on its own, so the chance of no shared bucket follows from the rate per table.
    some = min(tables, 12)
    own, other = (vector_dedup.vector_buckets(v, salt, some, hashes) for v in (a, b))
    per_table = own.shape[1] // some
    rate = np.mean([[bool(np.isin(own[i, t * per_table : (t + 1) * per_table], other[i]).any()) for t in range(some)] for i in range(400)])
    assert (1 - rate) ** tables <= 1 - vector_dedup.RECALL


def test_hadamard_is_orthogonal():
    matrix = vector_dedup.hadamard(np.eye(16))
    assert (matrix @ matrix.T == 16 * np.eye(16)).all()


def brute(data, threshold=0.98):
    def usable(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = len(data)
    unit = [np.array(r[1], np.float64) if usable(r[1], r[2]) else None for r in data]
    unit = [None if u is None else u / np.linalg.norm(u) for u in unit]
    linked = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and data[i][2] == data[j][2]
               and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(n)]
    out = []
    for i in range(n):
        seen, stack = {i}, [i]
        while stack:
            for y in linked[stack.pop()]:
                if y not in seen:
                    seen.add(y)
                    stack.append(y)
        ids = [data[j][0] for j in seen if data[j][0] is not None]
        head = min(ids) if ids else None
        out.append((data[i][0], len(linked[i]), head, data[i][0] == head))
    return sorted(out, key=str)


def found(frame):
    return sorted(map(tuple, vector_dedup.find_near(frame).collect()), key=str)


def test_edge_rows(spark):
    base = [float(x) for x in np.random.default_rng(2).normal(size=8).astype(np.float32)]
    near = [x + 0.001 for x in base]
    data = [
        (1, base, 0), (2, near, 0), (3, base, 1), (4, base, None), (5, None, 0), (6, [], 0), (7, [0.0] * 8, 0),
        (8, [None, *base[1:]], 0), (9, [float("nan"), *base[1:]], 0), (10, [float("inf"), *base[1:]], 0),
        (11, [2 * x for x in base], 0), (11, [2 * x for x in base], 0), (None, base, 0), (None, [1.0], 0), (12, base[:4], 0),
        (13, [1e-38 * x for x in base], 0), (14, [3e37 * x for x in base], 0), (15, [-x for x in base], 0), (16, [1.0], 0),
    ]
    frame = spark.createDataFrame([(*r, True, "x") for r in data], SCHEMA)
    data = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in data]
    assert found(frame) == brute(data)


def test_dense_group_and_random_vectors(spark):
    draw = np.random.default_rng(5)
    center = draw.normal(size=32)
    dense = center + 0.02 * draw.normal(size=(120, 32))
    rest = draw.normal(size=(200, 32))
    rows = [(i, [float(x) for x in v.astype(np.float32)], int(i % 2)) for i, v in enumerate(np.concatenate((dense, rest)))]
    frame = spark.createDataFrame([(*r, True, "x") for r in rows], SCHEMA).repartition(4)
    assert found(frame) == brute(rows)


def test_empty_and_unusable_tables(spark):
    assert vector_dedup.find_near(spark.createDataFrame([], SCHEMA)).count() == 0
    assert found(spark.createDataFrame([(1, None, None, True, "x")], SCHEMA)) == [(1, 0, 1, True)]


def test_unit_rows_of_a_slice():
    column = pa.array([[9.0], [3.0, 4.0], None, [1.0, None], [0.0, 2.0]], pa.list_(pa.float32())).slice(1)
    ((places, unit),) = vector_dedup.unit_rows(column)
    assert places.tolist() == [0, 3] and unit.tolist() == [[0.6, 0.8], [0.0, 1.0]]
