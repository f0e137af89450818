"""How filters overlap: what each removes at every place of every order, from counts of failure masks.

A document's mask says which filters it fails. Only the counts of masks matter, so documents are counted by
(part, mask) with map-side sums: a part has at most 2^filters masks, however many documents it holds. In
numpy, the masks (0 for a failed filter, infinity for a passed one) and each order's inverse permutation (the
place of each filter) are combined by a min-plus product: the least place of a failed filter is the step that
removes the mask. Scattering the counts to these steps gives what is removed, kept and redundant.

Null texts are empty, null parts are the empty string. A document is a copy when a smaller id has the same
text in any part; null ids count as greater than all others, and rows that share an id aren't copies of each
other. A document is good or toxic when any row of `labels` with its id says so; null ids have no labels.
An empty table has no parts and so no rows. Other columns of either table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.storage import written
from panelweave.operators.skew import attach_groups

SPACE = r"[\x20\x09-\x0D]+"
# Masks and orders grow fast with the filters; with seven a part has 128 masks and 5,040 orders.
MOST_FILTERS = 7
COUNTS = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def text_failures(text: Column) -> dict[str, Column]:
    """Few words, repeated words, capitals, markup characters: true where a whole text fails."""
    words = F.array_remove(F.split(text, SPACE), "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < 100,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 80,
        "C": capitals.cast("long") * 100 > F.length(text).cast("long") * 10,
        "D": text.rlike("[#$%&*|]"),
    }


def failure_masks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row per document: doc_id, part, mask. Bit i is set where the i-th of filters A to E fails.

    Texts are read once; copies are found by their digests, of which only the repeated ones are joined back.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    bits = [F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(text_failures(whole).values())]
    own = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        sum(bits[1:], bits[0]).alias("own"),
        F.unhex(F.sha2(whole, 256)).alias("digest"),
    )
    rows = written(own, "masks")
    texts = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    joined = attach_groups(rows, texts.where("copies > 1").drop("copies"), ["digest"])
    later = F.coalesce(F.col("doc_id") > F.col("first_id"), F.col("doc_id").isNull() & F.col("first_id").isNotNull())
    return joined.select("doc_id", "part", (F.col("own") + F.when(later, 1 << len(bits)).otherwise(0)).alias("mask"))


def label_flags(labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """One row per labelled id: doc_id, good, toxic."""
    one = lambda name: F.max(F.when(F.col(name) == 1, 1).otherwise(0))
    named = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id"))
    return named.agg(one(quality).alias("good"), one(toxic).alias("toxic"))


def removal_ranks(fails: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Masks x orders: the place of the first failed filter, or the number of filters where none fails.

    `fails` is masks x filters, `places` filters x orders (the inverse permutations); their min-plus product.
    """
    never = len(places)
    cost = np.where(fails, 0, never)
    ranks = np.full((len(fails), places.shape[1]), never)
    for f in range(never):
        np.minimum(ranks, cost[:, f, None] + places[f], out=ranks)
    return ranks


def interactions(masks: np.ndarray, weights: np.ndarray, orders: np.ndarray) -> dict[str, np.ndarray]:
    """Counts per order and step (orders x filters) of one part.

    `weights` is 3 x masks: documents, good ones, toxic ones. `orders` is orders x filters, the filter of each step.
    """
    n_orders, n = orders.shape
    fails = (masks[:, None] >> np.arange(n) & 1).astype(bool)
    ranks = removal_ranks(fails, np.argsort(orders, axis=1).T)
    lost = np.zeros((3, n_orders, n + 1), np.int64)
    for kind in range(3):
        np.add.at(lost[kind], (np.arange(n_orders), ranks), weights[kind][:, None])
    removed = lost[0, :, :n]
    failing = weights[0] @ fails
    alone = np.array([weights[0][masks == 1 << f].sum() for f in range(n)], np.int64)
    shapley = np.zeros(n, np.int64)
    np.add.at(shapley, orders, removed)
    return {
        "kept": weights[0].sum() - removed.cumsum(axis=1),
        "removed": removed,
        # Whatever fails the filter of a step is gone after it, so what it doesn't remove went earlier.
        "redundant": failing[orders] - removed,
        "unique_fails": alone[orders],
        "good_lost": lost[1, :, :n],
        "toxic_lost": lost[2, :, :n],
        "shapley": shapley[orders],
    }


def audit_masks(rows: DataFrame, filters: Sequence[str]) -> DataFrame:
    """Counts of every part, order and step from rows of (part, mask, good, toxic), one per document."""
    names = list(filters)
    if not 0 < len(names) <= MOST_FILTERS:
        raise ValueError(f"between 1 and {MOST_FILTERS} filters can be audited")
    counted = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))

    def expand(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        orders = np.array(list(permutations(range(len(names)))))
        texts = ["".join(names[f] for f in order) for order in orders]
        for frame in frames:
            for part, counts in zip(frame["part"], frame["counts"], strict=True):
                masks, *weights = np.array([tuple(c.values()) if isinstance(c, dict) else tuple(c) for c in counts], np.int64).T
                found = interactions(masks, np.array(weights), orders)
                yield pd.DataFrame(
                    {
                        "part": part,
                        "filter_order": np.repeat(texts, len(names)),
                        "step": np.tile(np.arange(1, len(names) + 1, dtype=np.int32), len(texts)),
                        **{name: found[name].ravel() for name in COUNTS},
                    }
                )

    longs = ", ".join(f"{name} long" for name in COUNTS)
    return parts.mapInPandas(expand, f"part string, filter_order string, step int, {longs}")


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Filters A to E over whole documents: part, filter_order, step and the counts of each."""
    flagged = attach_groups(failure_masks(docs, doc_id, text, part), label_flags(labels, doc_id), ["doc_id"])
    rows = flagged.select("part", "mask", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("good", "toxic")])
    return audit_masks(rows, "ABCDE")
