"""Packing documents into training sequences along a space-filling curve.

Every document becomes token ids and a vector of its ids hashed into `WIDTH` signed buckets, which a fixed
random matrix projects to `DIMS` numbers. Standardised over all documents and cut into 2^BITS steps each, they
are a cell of a grid whose number along the Hilbert curve is the sort key: documents that follow each other
share vocabulary. Rows are range-sorted by that key, ties by row number, so a group of equal documents spreads
over as many ranges as any other rows. Each range is laid out as one stream and cut every `SEQUENCE` tokens; its
last, shorter stretch is cut at powers of two, lengths that need no padding. So no token of padding is made,
ranges need nothing from each other, and a lost task is redone from the sorted shuffle.

Null and empty texts are the end token alone. Repeated rows and null ids are packed like any others: each row
has its own pieces. Whole texts are encoded; long ones in stretches cut before a blank, where no token of this
kind of vocabulary reaches across. Where the vocabulary allows it, a faster encoder gives the same ids as the
tokenizers library, which keeps the texts with special tokens and long runs of blanks. An empty table gives no pieces. Other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from panelweave.llm.batches import map_batches
from panelweave.llm.storage import written

SEQUENCE = 1024
END = 0
WIDTH = 512
DIMS, BITS = 4, 15
# Projected numbers are kept as whole multiples of 2^-SCALE, so their sums don't depend on the order of adding.
SCALE = 20
# Texts of about so many characters, and at most so many documents, are encoded at once.
CHARACTERS, DOCUMENTS = 1 << 20, 1 << 10
# Ids laid out at once.
TOKENS = 1 << 21
# Sequence numbers of one range start at a multiple of 2^RANGE_BITS.
RANGE_BITS = 40


# How byte-level vocabularies cut texts into words (fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The fast encoder's word pattern backtracks over blanks, so stretches with longer runs are left to the library.
LONG_BLANKS = re.compile(r"\s{1000}")


@cache
def _tokenizer(path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


@cache
def _fast(path: str) -> tuple[tiktoken.Encoding, tuple[str, ...]] | None:
    """The vocabulary for the faster encoder and the strings it must not see; None where ids could differ.

    That encoder merges by the number of the merged token. This is the same as the order of merges only if every
    merge makes a token of its own and these are numbered in that order.
    """
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    model, cut = told["model"], told.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    unusual = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    if not plain or told.get("normalizer") or any(model.get(k) for k in unusual):
        return None
    names = _byte_names()
    added = {t["content"] for t in told["added_tokens"]}
    vocabulary = {word: i for word, i in model["vocab"].items() if word not in added}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [vocabulary.get("".join(pair), -1) for pair in pairs]
    whole = all(set(word) <= names.keys() for word in vocabulary) and len(vocabulary) == len(made) + len(names)
    if not whole or made[:1] == [-1] or any(a >= b for a, b in zip(made, made[1:], strict=False)):
        return None
    ranks = {bytes(names[c] for c in word): i for word, i in vocabulary.items()}
    return tiktoken.Encoding("packing", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}), tuple(added)


def _byte_names() -> dict[str, int]:
    """The character that stands for each byte: itself if it shows in Latin-1, else one after the first 256, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted(set(range(256)) - set(shown))
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _encode(parts: list[str], path: str) -> list[np.ndarray]:
    """Ids of each part, as the tokenizers library gives them."""
    fast = _fast(path)
    out: list[np.ndarray | None] = [None] * len(parts)
    if fast:
        encoding, kept_away = fast
        for i, part in enumerate(parts):
            if not LONG_BLANKS.search(part) and not any(word in part for word in kept_away):
                out[i] = encoding.encode_to_numpy(part, disallowed_special=())
    rest = [i for i, ids in enumerate(out) if ids is None]
    found = _tokenizer(path).encode_batch_fast([parts[i] for i in rest], add_special_tokens=False)
    for i, one in zip(rest, found, strict=True):
        out[i] = np.array(one.ids, np.uint32)
    return out


def stretches(text: str, size: int = CHARACTERS) -> list[str]:
    """The text in parts of at least `size` characters, cut only before a blank that follows a visible character."""
    out, start = [], 0
    while len(text) - start > size:
        cut = text.find(" ", start + size)
        while cut > 0 and text[cut - 1].isspace():
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        out.append(text[start:cut])
        start = cut
    return [*out, text[start:]]


def token_ids(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids in one array, the end token after each text, and the number of ids of each text."""
    parts = [stretches(t) for t in texts]
    found = iter(_encode([s for p in parts for s in p], path))
    ids = [[next(found) for _ in p] for p in parts]
    sizes = np.array([sum(map(len, i)) + 1 for i in ids], np.int64)
    flat = np.full(int(sizes.sum()), END, np.uint32)
    at = 0
    for one, size in zip(ids, sizes, strict=True):
        end = at
        for part in one:
            flat[end : end + len(part)] = part
            end += len(part)
        at += size
    return flat, sizes


@cache
def _matrix() -> np.ndarray:
    return np.random.default_rng(20).normal(size=(WIDTH, DIMS))


def projections(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Documents x DIMS: the hashed vector of each document, of length one, times the random matrix."""
    mixed = (flat.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    bucket = (mixed % np.uint64(WIDTH)).astype(np.int64)
    sign = 1.0 - 2.0 * ((mixed >> np.uint64(20)) & np.uint64(1)).astype(np.float64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    vectors = np.bincount(owner * WIDTH + bucket, weights=sign, minlength=len(sizes) * WIDTH).reshape(len(sizes), WIDTH)
    vectors = np.sign(vectors) * np.sqrt(np.abs(vectors))
    norms = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return (vectors / np.where(norms > 0, norms, 1.0)) @ _matrix()


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place of each cell (rows x dimensions, whole numbers below 2^bits) along the Hilbert curve."""
    axes = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    step = 1 << (bits - 1)
    while step > 1:
        below = step - 1
        for i, axis in enumerate(axes):
            high = (axis & step) != 0
            swap = np.where(high, 0, (axes[0] ^ axis) & below)
            axes[0] = axes[0] ^ np.where(high, below, swap)
            if i:
                axes[i] = axis ^ swap
        step >>= 1
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    flips = np.zeros_like(axes[0])
    for b in range(bits - 1, 0, -1):
        flips ^= np.where((axes[-1] >> b) & 1, (1 << b) - 1, 0)
    key = np.zeros_like(axes[0])
    for b in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << 1) | (((axis ^ flips) >> b) & 1)
    return key


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts of a bounded number of documents and characters at a time."""
    for batch in batches:
        sizes = batch.column("size").to_numpy()
        group = np.maximum(sizes.cumsum() // CHARACTERS, np.arange(len(sizes)) // DOCUMENTS)
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            if high > low:
                yield batch.column("doc_id").slice(low, high - low), batch.column("text").slice(low, high - low).to_pylist()


def tokenised(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A written table with one row per document: row, doc_id, ids, n_tokens, and the numbers x0, x1, ...

    `ids` holds little-endian whole numbers, of two bytes where the vocabulary allows, else of four.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    named = docs.select(F.col(doc_id).alias("doc_id"), whole.alias("text"), F.length(whole).alias("size"))
    kind = _kind(path)
    numbers = [f"x{i}" for i in range(DIMS)]
    schema = T.StructType(
        [
            T.StructField("doc_id", named.schema["doc_id"].dataType),
            T.StructField("ids", T.BinaryType()),
            T.StructField("n_tokens", T.LongType()),
            *[T.StructField(x, T.LongType()) for x in numbers],
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, texts in _groups(batches):
            flat, sizes = token_ids(texts, path)
            places = np.rint(projections(flat, sizes) * (1 << SCALE)).astype(np.int64)
            columns = [doc_ids, _binaries(flat.astype(kind), sizes), pa.array(sizes), *[pa.array(places[:, i]) for i in range(DIMS)]]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return written(map_batches(named, run, schema).withColumn("row", F.monotonically_increasing_id()), "tokens")


def _kind(path: str) -> str:
    return "<u2" if _tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4"


def _binaries(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """One binary value for each run of `sizes` numbers in `flat`."""
    ends = np.concatenate(([0], np.cumsum(sizes))) * flat.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


def _numbers(column: pa.Array, kind: str) -> np.ndarray:
    """The numbers of all binary values, one after the other."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view(kind)


def curve_ordered(tokens: DataFrame) -> DataFrame:
    """Add `key`, the place of each document's cell along the curve."""
    numbers = [f"x{i}" for i in range(DIMS)]
    wide = lambda c: F.sum(c.cast("decimal(38,0)"))
    sums = tokens.agg(F.count("*"), *[wide(F.col(x)) for x in numbers], *[wide(F.col(x).cast("decimal(19,0)") * F.col(x)) for x in numbers]).first()
    n, first, second = sums[0], sums[1 : 1 + DIMS], sums[1 + DIMS :]
    mean = [float(s) / n if n else 0.0 for s in first]
    spread = [max(float(q) / n - m * m, 1.0) ** 0.5 if n else 1.0 for q, m in zip(second, mean, strict=True)]

    @F.pandas_udf("long")
    def key(*columns: pd.Series) -> pd.Series:
        at = (np.stack([c.to_numpy(np.float64) for c in columns], axis=1) - mean) / spread
        # The logistic curve is near the normal one, so cells are about equally full.
        share = 1.0 / (1.0 + np.exp(-1.702 * np.clip(at, -30, 30)))
        return pd.Series(hilbert_key(np.minimum(share * (1 << BITS), (1 << BITS) - 1).astype(np.int64), BITS))

    return tokens.withColumn("key", key(*numbers))


def tail_cuts(size: int) -> np.ndarray:
    """Ends of stretches whose lengths are the powers of two that `size` is made of, the largest first."""
    return np.cumsum([1 << b for b in range(size.bit_length() - 1, -1, -1) if size >> b & 1], dtype=np.int64)


class _Stream:
    """Documents of one range laid end to end; `take` hands out the pieces of finished sequences."""

    def __init__(self, first_sequence: int, doc_kind: pa.DataType):
        self.sequence = first_sequence
        self.doc_ids = pa.array([], doc_kind)
        self.totals = self.starts = self.lengths = np.zeros(0, np.int64)
        self.ids = np.zeros(0, "<u4")

    def add(self, doc_ids: pa.Array, totals: np.ndarray, ids: np.ndarray) -> None:
        self.doc_ids = pa.concat_arrays([self.doc_ids, doc_ids])
        self.totals = np.concatenate((self.totals, totals))
        self.starts = np.concatenate((self.starts, np.zeros_like(totals)))
        self.lengths = np.concatenate((self.lengths, totals))
        self.ids = np.concatenate((self.ids, ids.astype("<u4")))

    def take(self, last: bool) -> list[pa.Array]:
        """Columns of the pieces up to the last full sequence; of all with `last`."""
        size = len(self.ids)
        cuts = np.arange(SEQUENCE, size + 1, SEQUENCE)
        if last:
            cuts = np.concatenate((cuts, size - size % SEQUENCE + tail_cuts(size % SEQUENCE)))
        until = int(cuts[-1]) if len(cuts) else 0
        begins = np.concatenate(([0], cuts[:-1])).astype(np.int64)[: len(cuts)]
        ends = np.cumsum(self.lengths)
        heads = ends - self.lengths
        at = np.union1d(heads[heads < until], begins)
        stops = np.append(at[1:], until)[: len(at)]
        doc = np.searchsorted(heads, at, "right") - 1
        within = np.searchsorted(begins, at, "right") - 1
        out = [
            self.doc_ids.take(pa.array(doc)),
            pa.array(self.starts[doc] + at - heads[doc]),
            pa.array(stops - at),
            _binaries(self.ids[:until], stops - at),
            pa.array(self.totals[doc]),
            pa.array(self.sequence + within),
            pa.array(at - begins[within]),
        ]
        keep = int(np.searchsorted(ends, until, "right"))
        cut = max(0, until - int(heads[keep])) if keep < len(heads) else 0
        self.sequence += len(cuts)
        self.doc_ids, self.totals = pa.concat_arrays([self.doc_ids.slice(keep)]), self.totals[keep:]
        self.starts, self.lengths, self.ids = self.starts[keep:].copy(), self.lengths[keep:].copy(), self.ids[until:].copy()
        if cut:
            self.starts[0] += cut
            self.lengths[0] -= cut
        return out


def pack(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    `ids` are the piece's token ids as little-endian numbers of four bytes. Every sequence is `SEQUENCE` tokens
    long or a power of two. The vocabulary file must be readable by every executor.
    """
    tokens = tokenised(docs, path, doc_id, text)
    ordered = curve_ordered(tokens).repartitionByRange("key", "row").sortWithinPartitions("key", "row")
    kind = _kind(path)
    schema = T.StructType(
        [
            T.StructField("doc_id", tokens.schema["doc_id"].dataType),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("doc_tokens", T.LongType()),
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = None
        for batch in batches:
            totals = batch.column("n_tokens").to_numpy()
            group = totals.cumsum() // TOKENS
            edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(totals)]
            if stream is None:
                stream = _Stream(TaskContext.get().partitionId() << RANGE_BITS, batch.column("doc_id").type)
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                part = batch.slice(low, high - low)
                stream.add(part.column("doc_id"), totals[low:high], _numbers(part.column("ids"), kind))
                yield pa.RecordBatch.from_arrays(stream.take(last=False), schema.names)
        if stream is not None:
            yield pa.RecordBatch.from_arrays(stream.take(last=True), schema.names)

    return map_batches(ordered.select("doc_id", "ids", "n_tokens"), run, schema)


def sequences(pieces: DataFrame, pad: int = END) -> DataFrame:
    """One row per sequence of packed pieces: sequence_id, n_tokens, doc_ids, ids.

    `doc_ids` and `ids` follow the offsets; a sequence holds at most `SEQUENCE` pieces. A length that is no power of
    two is padded to `SEQUENCE` with `pad`; `pack` leaves none such.
    """
    one = F.struct("offset", "doc_id", "ids")
    joined = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(one)).alias("pieces"))
    schema = f"sequence_id long, n_tokens long, doc_ids array<{pieces.schema['doc_id'].dataType.simpleString()}>, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for size, parts in zip(batch.column("n_tokens").to_pylist(), batch.column("pieces").to_pylist(), strict=True):
                ids = np.frombuffer(b"".join(p["ids"] for p in parts), "<u4")
                width = size if size & (size - 1) == 0 else SEQUENCE
                rows.append(([p["doc_id"] for p in parts], np.concatenate((ids, np.full(width - size, pad))).astype(np.int32)))
            kind = batch.schema.field("pieces").type.value_type.field("doc_id").type
            doc_ids = pa.array([r[0] for r in rows], pa.list_(kind))
            columns = [batch.column("sequence_id"), batch.column("n_tokens"), doc_ids, pa.array([r[1] for r in rows], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(zip("sequence_id n_tokens doc_ids ids".split(), [c.type for c in columns], strict=True))))

    return joined.mapInArrow(run, schema)
