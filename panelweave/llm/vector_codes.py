"""Product codes of vectors: codebooks by rounds of means, nearest entries by a GNAT over the entries.

Components become whole numbers, floor(4096 x). Vectors are cut into `PARTS` equal parts; each part has a
codebook that starts as that part of the first vectors by id. A round assigns every part of every vector to its
nearest entry and replaces each entry by the floor of its parts' mean. Executors read the written integer table,
keep whole-number sums per entry and send those; the driver holds the codebooks alone, a few thousand numbers.

The nearest entry is found in a geometric near-neighbour access tree, searched for a whole batch at a time. A
node has split points, each with the entries nearest to it below, and the least and greatest distance from every
split point to every child's entries. By the triangle inequality a query's distance to one split point rules out
children whole. Only children that are strictly farther than the best entry so far are left out, with a margin
above the rounding of square roots; distances are compared as whole numbers, ties going to the lower index, so
codes are exactly those of comparing all entries.

Vectors that are null or hold null or non-finite components are dropped. Null ids come last in the choice of first
entries; rows that tie in id are taken by their components. Fewer rows than entries make a smaller codebook.
Shorter vectors, and widths that the parts don't divide, are filled up with zeros to the widest; empty vectors are
all zeros. Components are held within +-2^24 (x within 4,096), so that all sums are exact in 64 bits up to 8,192
components. Repeated rows are coded each, null labels are one label, an empty table gives no rows, other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.llm.storage import remove, written
from panelweave.operators.skew import attach_groups

SCALE = 4096
LIMIT = 1 << 24
PARTS, ENTRIES, ROUNDS = 8, 16, 6
FANOUT = 4
# Square roots of 64-bit numbers are off by far less than this share.
MARGIN = 1e-12
# Components handled at once in numpy.
CHUNK = 1 << 20


class Node:
    """Split points, their children and the distances (least, greatest) from each split point to each child's entries."""

    def __init__(self, entries: np.ndarray, index: np.ndarray, fanout: int = FANOUT):
        self.points = _spread_out(entries, index, min(fanout, len(index)))
        rest = np.setdiff1d(index, self.points)
        nearest = _squares(entries[rest], entries[self.points]).argmin(axis=1)
        members = [rest[nearest == i] for i in range(len(self.points))]
        self.children = [Node(entries, m, fanout) if len(m) else None for m in members]
        spans = np.sqrt(_squares(entries[self.points], entries).astype(np.float64))
        groups = [np.append(m, p) for m, p in zip(members, self.points, strict=True)]
        self.least = np.array([[row[g].min() for g in groups] for row in spans])
        self.greatest = np.array([[row[g].max() for g in groups] for row in spans])


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = a[:, None, :] - b[None, :, :]
    return (gap * gap).sum(axis=2)


def _spread_out(entries: np.ndarray, index: np.ndarray, count: int) -> np.ndarray:
    """`count` of the entries at `index`, each the farthest from those chosen before."""
    chosen = [int(index[0])]
    far = _squares(entries[index], entries[chosen])[:, 0]
    while len(chosen) < count:
        # Copies of chosen entries are at distance zero, so a place is never chosen twice.
        far[np.isin(index, chosen)] = -1
        chosen.append(int(index[far.argmax()]))
        far = np.minimum(far, _squares(entries[index], entries[chosen[-1:]])[:, 0])
    return np.array(chosen)


class Gnat:
    """Nearest entries of a codebook (entries x components, 64-bit whole numbers)."""

    def __init__(self, entries: np.ndarray):
        self.entries = np.ascontiguousarray(entries, np.int64)
        self.root = Node(self.entries, np.arange(len(entries)))
        self.compared = 0

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each query's nearest entry, ties to the lower index."""
        self._queries = queries
        self._square = np.full(len(queries), np.iinfo(np.int64).max)
        self._index = np.full(len(queries), len(self.entries))
        self._search(self.root, np.arange(len(queries)))
        return self._index, self._square

    def _search(self, node: Node, rows: np.ndarray) -> None:
        alive = np.ones((len(rows), len(node.points)), bool)
        for i, point in enumerate(node.points):
            at = np.flatnonzero(alive[:, i])
            if not len(at):
                continue
            mine = rows[at]
            gap = self._queries[mine] - self.entries[point]
            square = (gap * gap).sum(axis=1)
            self.compared += len(mine)
            best, index = self._square[mine], self._index[mine]
            closer = (square < best) | ((square == best) & (point < index))
            self._square[mine] = best = np.where(closer, square, best)
            self._index[mine] = np.where(closer, point, index)
            far, reach = np.sqrt(square.astype(np.float64))[:, None], np.sqrt(best.astype(np.float64))[:, None]
            beyond = far * (1 - MARGIN) - reach * (1 + MARGIN) > node.greatest[i] * (1 + MARGIN)
            short = (far + reach) * (1 + MARGIN) < node.least[i] * (1 - MARGIN)
            alive[at] &= ~(beyond | short)
        for i, child in enumerate(node.children):
            if child is not None and alive[:, i].any():
                self._search(child, rows[alive[:, i]])


def integer_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """The usable rows: vec_id, label, components (whole numbers)."""
    values = F.col(embedding).cast("array<double>")
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x, F.lit(1e9)), F.lit(-1e9)) * SCALE), F.lit(LIMIT)), F.lit(-LIMIT))
    named = vectors.where(F.col(embedding).isNotNull() & finite)
    return named.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.transform(values, lambda x: held(x).cast("int")).alias("components"))


def _matrices(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, rows x width) of a bounded number of components at a time, filled up with zeros."""
    column = batch.column("components")
    rows = max(1, CHUNK // width)
    for start in range(0, batch.num_rows, rows):
        part = column.slice(start, rows)
        sizes = part.value_lengths().to_numpy()
        flat = part.flatten().to_numpy()
        out = np.zeros((len(part), width), np.int64)
        out[np.arange(width) < sizes[:, None]] = flat
        yield start, out


def _assigned(matrix: np.ndarray, trees: list[Gnat]) -> tuple[np.ndarray, np.ndarray]:
    """Rows x parts: index and squared distance of each part's nearest entry."""
    parts = matrix.reshape(len(matrix), len(trees), -1)
    found = [tree.nearest(np.ascontiguousarray(parts[:, p])) for p, tree in enumerate(trees)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def improved(table: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (parts x entries x components) after one round over `table`."""
    parts, entries, size = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(book) for book in books]
        sums = np.zeros((parts * entries, size + 1), np.int64)
        for batch in batches:
            for _, matrix in _matrices(batch, parts * size):
                index, _ = _assigned(matrix, trees)
                group = (index + np.arange(parts) * entries).ravel()
                order = np.argsort(group, kind="stable")
                used, first = np.unique(group[order], return_index=True)
                sums[used, :size] += np.add.reduceat(matrix.reshape(-1, size)[order], first, axis=0)
                sums[:, size] += np.bincount(group, minlength=parts * entries)
        place, position = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(position, pa.int32()), pa.array(sums[place, position])], ["place", "position", "total"])

    added = table.select("components").mapInArrow(add, "place int, position int, total long")
    # At most parts x entries x (components + 1) rows reach the driver.
    totals = np.zeros((parts * entries, size + 1), np.int64)
    for r in added.groupBy("place", "position").agg(F.sum("total").alias("total")).collect():
        totals[r.place, r.position] = r.total
    counts = totals[:, size:]
    means = totals[:, :size] // np.maximum(counts, 1)
    return np.where(counts > 0, means, books.reshape(parts * entries, size)).reshape(books.shape)


def fit(table: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts x entries x components) of the integer `table`, whose widest vector has `width` components."""
    size = max(1, -(-width // parts))
    first = table.orderBy(F.col("vec_id").asc_nulls_last(), "components").limit(entries).select("components").collect()
    start = np.zeros((len(first), parts * size), np.int64)
    for i, r in enumerate(first):
        start[i, : len(r.components)] = r.components
    books = np.ascontiguousarray(start.reshape(len(first), parts, size).transpose(1, 0, 2))
    for _ in range(rounds if len(first) else 0):
        books = improved(table, books)
    return books


def encode(table: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error of every row of the integer `table`."""
    parts, entries, size = books.shape
    if entries > 256:
        raise ValueError("two hex digits name at most 256 entries")
    schema = T.StructType([table.schema["vec_id"], table.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(book) for book in books]
        for batch in batches:
            for start, matrix in _matrices(batch, parts * size):
                index, square = _assigned(matrix, trees)
                codes = [row.tobytes().hex() for row in index.astype(np.uint8)]
                ids, labels = (batch.column(c).slice(start, len(codes)) for c in ("vec_id", "label"))
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(codes, pa.string()), pa.array(square.sum(axis=1))], schema.names)

    return table.mapInArrow(run, schema)


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' decimal components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> DataFrame:
    """One row per usable vector: vec_id, code, error, label_error, codebooks_sha256."""
    table = written(integer_vectors(vectors, vec_id, embedding, label), "components")
    width = table.agg(F.max(F.size("components"))).first()[0] or 0
    books = fit(table, width, parts, entries, rounds)
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias("label_key")
    coded = written((encode(table, books) if books.shape[1] else _nothing(table)).select("vec_id", key, "code", "error"), "codes")
    remove(table)
    sums = coded.groupBy("label_key").agg(F.sum("error").alias("label_error"))
    return attach_groups(coded, sums, ["label_key"]).select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _nothing(table: DataFrame) -> DataFrame:
    return table.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).where(F.lit(False))
