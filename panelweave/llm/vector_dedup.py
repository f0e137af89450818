"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

A rotation is three rounds of random signs and a Walsh-Hadamard transform; its hash is the nearest signed axis.
A table joins several hashes to one bucket. Every vector is put into its own bucket and, as multiprobe, into
those where one hash, or the two least certain ones, take the second nearest axis. Pairs that share a bucket are
verified by cosine in double precision.

The hashes per table grow with the logarithm of the rows, so buckets stay small, and the number of tables follows
from the wanted recall at the threshold.

Only vectors of equal, non-null labels and equal lengths are compared. Null, empty and zero vectors and those with
null or non-finite components link with nothing. Byte-equal vectors of a label are one class, checked once.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.linking import block_tasks, linked_classes, verified_links
from panelweave.llm.storage import written
from panelweave.operators.skew import attach_groups

THRESHOLD = 0.98
RECALL = 0.9999
# Chance that one hash of two vectors at cosine 0.98 agrees, the second axis allowed. Measured in tables of three and
# four hashes it is 0.96 in 64 dimensions, 0.94 in 256 and 0.92 in 1024.
AGREEMENT = 0.9
ROUNDS = 3
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def choose_tables(rows: int, axes: int, recall: float = RECALL) -> tuple[int, int]:
    """(tables, hashes per table): buckets well above the rows in number, tables for the recall."""
    hashes = 1 + math.ceil(math.log(max(rows, 2)) / math.log(2 * max(axes, 2)))
    return math.ceil(math.log(1 - recall) / math.log(1 - AGREEMENT**hashes)), hashes


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row; the width is a power of two."""
    rows, width = x.shape
    step = 1
    while step < width:
        pairs = x.reshape(rows, width // (2 * step), 2, step)
        x = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(rows, width)
        step *= 2
    return x


def vector_buckets(unit: np.ndarray, salt: np.ndarray, tables: int, hashes: int) -> np.ndarray:
    """The buckets of each row of `unit`: own and probed ones of all tables, mixed with the row's `salt`."""
    rows, size = unit.shape
    width = 1 << max(1, (size - 1).bit_length())
    padded = np.zeros((rows, width))
    padded[:, :size] = unit
    at = np.arange(rows)
    out = []
    for table in range(tables):
        best, second, gap = (np.empty((hashes, rows), kind) for kind in (np.uint64, np.uint64, float))
        for h in range(hashes):
            signs = np.random.default_rng((table, h, width)).choice((-1.0, 1.0), (ROUNDS, width))
            x = padded
            for sign in signs:
                x = hadamard(x * sign) / math.sqrt(width)
            far = np.abs(x)
            first = far.argmax(axis=1)
            most = far[at, first]
            far[at, first] = -1
            next_ = far.argmax(axis=1)
            best[h], second[h] = 2 * first + (x[at, first] < 0), 2 * next_ + (x[at, next_] < 0)
            gap[h] = most - far[at, next_]
        order = gap.argsort(axis=0, kind="stable")
        swaps = [(), *((h,) for h in range(hashes)), *([(0, 1)] if hashes > 1 else [])]
        for swap in swaps:
            codes = best.copy()
            for place in swap:
                codes[order[place], at] = second[order[place], at]
            mixed = salt ^ np.uint64(table + 1)
            for code in codes:
                mixed = (mixed ^ code) * _PRIME
                mixed ^= mixed >> np.uint64(29)
            out.append(mixed)
    return np.stack(out, axis=1).view(np.int64) if out else np.empty((rows, 0), np.int64)


def unit_rows(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, unit vectors) of the usable vectors of a list column, by length."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else sizes
    found = []
    for size in np.unique(sizes[sizes > 0]):
        places = np.flatnonzero(sizes == size)
        rows = values[starts[places][:, None] + np.arange(size)]
        most = np.abs(rows).max(axis=1)
        good = np.isfinite(most) & (most > 0)
        rows = rows[good] / most[good][:, None]
        found.append((places[good], rows / np.linalg.norm(rows, axis=1, keepdims=True)))
    return found


def _signed(vectors: DataFrame, tables: int, hashes: int) -> DataFrame:
    """(vec_id, key, label, unit, buckets) of rows of (vec_id, label, embedding); key is null for rows without links."""
    names = ["vec_id", "key", "label", "unit", "buckets"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            keys: list = [None] * n
            units: list = [None] * n
            buckets: list = [None] * n
            labels = batch.column("label").to_pylist()
            for places, unit in unit_rows(batch.column("embedding")):
                labelled = np.array([labels[i] is not None for i in places], bool)
                places, unit = places[labelled], unit[labelled]
                prefix = [f"{labels[i]}/{unit.shape[1]}/".encode() for i in places]
                salt = np.array([int.from_bytes(hashlib.md5(p).digest()[:8], "big") for p in prefix], np.uint64)
                own = vector_buckets(unit, salt, tables, hashes)
                for j, i in enumerate(places):
                    keys[i] = hashlib.md5(prefix[j] + unit[j].tobytes()).hexdigest()
                    units[i], buckets[i] = unit[j], np.unique(own[j])
            arrays = [pa.array(keys, pa.string()), batch.column("label"), pa.array(units, pa.list_(pa.float64())), pa.array(buckets, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), *arrays], names)

    id_type, label_type = (vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    return vectors.mapInArrow(run, f"vec_id {id_type}, key string, label {label_type}, unit array<double>, buckets array<long>")


def similar_vectors(threshold: float):
    """The matrix of pairs at or above the cosine, from frames with `unit` and `label`."""

    def similar(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
        size = max(max(map(len, x["unit"]), default=0) for x in (a, b))
        left, right = (np.zeros((len(x), size)) for x in (a, b))
        for matrix, frame in ((left, a), (right, b)):
            for i, unit in enumerate(frame["unit"]):
                matrix[i, : len(unit)] = unit
        lengths = [np.fromiter(map(len, x["unit"]), np.int64, len(x)) for x in (a, b)]
        same = (lengths[0][:, None] == lengths[1]) & (a["label"].to_numpy()[:, None] == b["label"].to_numpy())
        return (left @ right.T >= threshold) & same

    return similar


def find_near(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD, recall: float = RECALL
) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Null ids count as links of others but never name a component while another id is there.
    """
    named = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("embedding"))
    rows, axes = named.agg(F.count("*"), F.max(F.size("embedding"))).first()
    tables, hashes = choose_tables(rows, 1 << max(1, ((axes or 1) - 1).bit_length()), recall)
    signed = written(_signed(named, tables, hashes), "signed")
    known = signed.where("key IS NOT NULL")
    classes = known.groupBy("key").agg(
        F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("label", "unit", "buckets")]
    )
    classes = written(classes, "classes")
    buckets = classes.select(F.explode("buckets").alias("bucket"), F.col("key").alias("node"), F.lit(1).cast("long").alias("weight"))
    tasks = block_tasks(buckets)
    compared = tasks.join(classes.select(F.col("key").alias("node"), "copies", "label", "unit"), "node")
    counts, groups = linked_classes(verified_links(compared, similar_vectors(threshold)))
    joined = classes.select(F.col("key").alias("node"), "first_id", "copies").join(counts, "node", "left").join(groups, "node", "left")
    joined = joined.withColumn("component", F.coalesce("component", "node"))
    heads = joined.groupBy("component").agg(F.min("first_id").alias("component_id"))
    result = attach_groups(joined, heads, ["component"]).select(
        F.col("node").alias("key"), (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    linked = attach_groups(known.select("vec_id", "key"), result, ["key"]).select("vec_id", "n_links", "component_id")
    alone = signed.where("key IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
