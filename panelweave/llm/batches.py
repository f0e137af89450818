"""Arrow batches inside tasks: bounded parts, output names, and memory given back when a task ends."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Batches = Iterator[pa.RecordBatch]


def bounded(batches: Batches, column: str, size: int) -> Batches:
    """Slices of the batches in which `column`, of texts or lists, holds about `size` bytes or items; at least one row each."""
    for batch in batches:
        values = batch.column(column)
        lengths = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
        group = np.cumsum(pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False), dtype=np.int64) // size
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            if high > low:
                yield batch.slice(low, high - low)


def other_fields(docs: DataFrame, made: Sequence[str]) -> list[T.StructField]:
    """The fields of `docs` without those that columns named `made` replace; case doesn't tell names apart."""
    taken = {name.lower() for name in made}
    return [f for f in docs.schema.fields if f.name.lower() not in taken]


def map_batches(docs: DataFrame, run: Callable[[Batches], Batches], kinds: T.StructType | str) -> DataFrame:
    """`docs.mapInArrow`, after which the reused worker keeps no freed memory."""

    def released(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            release()

    return docs.mapInArrow(released, kinds)


def release() -> None:
    """Return freed memory to the system, as far as the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
