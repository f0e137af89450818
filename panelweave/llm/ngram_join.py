"""N-gram Jaccard self-join by MinHash banding.

Texts become sets of hashed word n-grams (lower-cased words between white space; a text of fewer than n
words is one shorter n-gram, a text without words has none and links with nothing). Band and row counts
follow from the wanted recall at the threshold. Rows shuffle on band hashes, and pairs that share a band
are verified on their full n-gram sets.

Byte-equal texts are one class, checked once. Null texts count as empty. Repeated rows are copies of each
other; null ids are allowed, the class id is the smallest id in the class.
"""

from __future__ import annotations

import math
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.batches import Batches, bounded, map_batches
from panelweave.llm.linking import block_tasks, linked_classes, verified_links
from panelweave.llm.membership import filter_bits, filter_words, with_membership
from panelweave.llm.storage import written
from panelweave.operators.skew import attach_groups

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
MAX_HASHES = 128
# n-grams that weigh as much as one more node in a block.
WEIGHT = 4096
# Bytes of text taken from Spark's batches at once.
CHUNK = 1 << 21
# Columns of a block's membership matrix at a time.
STRIPE = 4096
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows per band whose bands still reach the recall at the threshold."""
    best = (max_hashes, 1)
    for rows in range(1, max_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(min(threshold, 1 - 1e-12) ** rows)))
        if bands * rows <= max_hashes:
            best = (bands, rows)
    return best


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams."""
    words = (text or "").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    codes = pd.util.hash_array(np.array(words, object), categorize=len(words) > 64)
    size = min(n, len(words))
    mixed = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        mixed = (mixed ^ codes[i : len(words) - size + 1 + i]) * _PRIME
        mixed ^= mixed >> np.uint64(31)
    return np.unique(mixed)


def _seeds(count: int) -> np.ndarray:
    return np.random.default_rng(20).integers(1, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The band hashes of one set; the band number is part of the hash."""
    least = np.empty(bands * rows, np.uint64)
    for i, seed in enumerate(_seeds(bands * rows)):
        least[i] = (grams * seed).min()
    # A product keeps low bits apart from high ones; mixing them spreads the minima over all 64 bits.
    mixed = np.arange(1, bands + 1, dtype=np.uint64) * _PRIME
    for column in least.reshape(bands, rows).T:
        mixed = (mixed ^ column ^ (column >> np.uint64(32))) * _PRIME
        mixed ^= mixed >> np.uint64(29)
    return mixed.view(np.int64)


def _key(text: str) -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")))


def _signed(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, key, hash, weight, bands) of each row of (doc_id, key, hash, text)."""

    def run(batches: Batches) -> Batches:
        for batch in bounded(batches, "text", CHUNK):
            weights, hashes = [], []
            for value in batch.column("text"):
                grams = shingles(value.as_py(), n)
                weights.append(1 + len(grams) // WEIGHT)
                hashes.append(band_hashes(grams, bands, rows) if len(grams) else np.empty(0, np.int64))
            arrays = [batch.column(c) for c in ("doc_id", "key", "hash")]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(weights, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], ["doc_id", "key", "hash", "weight", "bands"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs, run, f"doc_id {kind}, key string, hash long, weight long, bands array<long>")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """(node, grams) of rows of (key, text)."""

    def run(batches: Batches) -> Batches:
        for batch in bounded(batches, "text", CHUNK):
            grams = [shingles(v.as_py(), n).view(np.int64) for v in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(grams, pa.list_(pa.int64()))], ["node", "grams"])

    return map_batches(docs, run, "node string, grams array<long>")


def similar_sets(threshold: float):
    """The matrix of pairs with Jaccard similarity at or above the threshold, from frames with `grams`."""

    def similar(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
        sets = [*a["grams"], *([] if b is a else b["grams"])]
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        _, column, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), sizes)
        # An n-gram of one set only adds nothing to an overlap.
        often = uses > 1
        keep = often[column]
        row, column = row[keep], (np.cumsum(often) - 1)[column[keep]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((len(a), len(b)), np.float32)
        top = int(often.sum())
        cuts = np.searchsorted(column, np.arange(0, top + STRIPE, STRIPE))
        for k, (start, end) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            member = np.zeros((len(sets), min(STRIPE, top - k * STRIPE)), np.float32)
            member[row[start:end], column[start:end] - k * STRIPE] = 1
            common += member[: len(a)] @ (member if b is a else member[len(a) :]).T
        left, right = sizes[: len(a), None], (sizes if b is a else sizes[len(a) :])[None, :]
        # Sizes and overlaps are whole numbers; the tolerance only absorbs the threshold's own rounding.
        return common.astype(np.float64) >= threshold * (left + right - common) - 1e-9

    return similar


def find_similar(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL
) -> DataFrame:
    """One row per input row: doc_id, class_id, n_links (other rows linked directly), kept, text_key.

    `kept` holds for the rows of one text of each class: the text of the class's smallest id (texts without
    words are classes of their byte-equal copies). Among copies of that text, the rows with the smallest id.
    """
    named = docs.select(F.col(doc_id).alias("doc_id"), _key(text).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    named = named.withColumn("hash", F.xxhash64("key"))
    bands, rows = choose_bands(threshold, recall)
    signed = written(_signed(named, n, bands, rows), "signed")
    classes = signed.groupBy("key").agg(
        F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("weight").alias("weight"), F.first("hash").alias("hash"), F.first("bands").alias("bands")
    )
    classes = written(classes, "classes")
    buckets = classes.select(F.explode("bands").alias("bucket"), F.col("key").alias("node"), "weight")
    tasks = block_tasks(buckets)
    # Only candidate texts are read again: a filter of bounded size lets few others through, the join drops those.
    wanted = written(tasks.select("node").distinct().join(classes.select(F.col("key").alias("node"), "hash", "first_id", "copies"), "node"), "wanted")
    bits = filter_bits(wanted.count())
    read = with_membership(named, "hash", filter_words(wanted, "hash", bits), bits, "possible").where("possible")
    first = wanted.select(F.col("node").alias("key"), "first_id")
    once = attach_groups(read, first, ["key"], "inner").where(F.col("doc_id").eqNullSafe(F.col("first_id"))).select("key", "text")
    sets = written(_sets(once, n).dropDuplicates(["node"]), "sets")
    rows_of = tasks.join(wanted.select("node", "copies"), "node").join(sets, "node")
    counts, groups = linked_classes(verified_links(rows_of, similar_sets(threshold)))
    known = classes.select(F.col("key").alias("node"), "first_id", "copies", (F.size("bands") > 0).alias("worded"))
    joined = known.join(counts, "node", "left").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = joined.groupBy("component").agg(F.min("first_id").alias("class_id"))
    linked = F.when(F.col("worded"), F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).otherwise(0)
    result = attach_groups(joined, heads, ["component"]).select(F.col("node").alias("key"), linked.alias("n_links"), "class_id", "first_id", "component")
    chosen = result.where(F.col("first_id").eqNullSafe(F.col("class_id"))).groupBy("component").agg(F.min("key").alias("chosen"))
    result = attach_groups(result, chosen, ["component"])
    every = attach_groups(signed.select("doc_id", "key"), result, ["key"])
    kept = (F.col("key") == F.col("chosen")) & F.col("doc_id").eqNullSafe(F.col("class_id"))
    return every.select("doc_id", "class_id", F.col("n_links").cast("long").alias("n_links"), kept.alias("kept"), F.col("key").alias("text_key"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with one of each class kept; rows that no dropped text can match are not shuffled.

    Repeated rows of the kept text that tie in their id all stay: exact copies are another operator's work.
    """
    found = find_similar(docs, doc_id, text, n, threshold)
    dropped = found.where(~F.col("kept")).select(F.col("text_key").alias("key"), F.col("doc_id").alias("dropped_id")).distinct()
    dropped = written(dropped.withColumn("hash", F.xxhash64("key")), "dropped")
    bits = filter_bits(dropped.count())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), _key(text).alias("key"), F.col(doc_id).alias("id"))
    tested = with_membership(rows.withColumn("hash", F.xxhash64("key")), "hash", filter_words(dropped, "hash", bits), bits, "possible")
    other = dropped.select("key", "dropped_id")
    left = tested.where("possible").join(other, (tested["key"] == other["key"]) & tested["id"].eqNullSafe(other["dropped_id"]), "left_anti")
    return tested.where(~F.col("possible")).select("doc").unionByName(left.select("doc")).select("doc.*")
