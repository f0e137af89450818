"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled, repeatable order (MD5 of the id), played as many
times as the largest repeat allows. A piece of a document finishes at the virtual time

    (words its source has queued up to the piece's end) / (the source's target),

and the mix is the sequence of all pieces by virtual time, cut where its running total reaches the budget.
A document across its source's target is queued as two pieces, so the cut falls between pieces.

Nothing is ordered in one task: running totals within a source are prefix sums over `BUCKETS` ranges of the
shuffle order plus a window inside each range, and the global running total is a prefix sum over ranges of
virtual time.

Null texts have size 0, documents without words take nothing, null sources form one source, rows that tie
in id and size are interchangeable.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.llm.storage import written

BUCKETS = 4096
# Ranges of virtual time up to each source's target; later pieces share ranges up to twice that time.
TIMES = 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, repeats: int = 2) -> DataFrame:
    """Targets of `sizes` (source, source_size): source, source_size, target.

    Sources in code-point order, null last, take the weights in turn and share `share` of all words. A target
    stops at `repeats` times its source; the excess is shared again by weight until none is above.
    """
    spark = sizes.sparkSession
    ordered = written(sizes, "sources").orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex()
    kinds = "source string, source_size long, position long"
    table = written(spark.createDataFrame(ordered.map(lambda x: (x[0].source, x[0].source_size, x[1])), kinds), "ranked")
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    table = table.select("source", "source_size", cycle.alias("weight"), (F.col("source_size") * repeats).alias("most"))
    total, weight = table.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = share * (total or 0)
    level, capped = budget / weight if weight else 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > F.col("most")
        n, held, open_weight = table.agg(F.count_if(over), F.sum(F.when(over, F.col("most"))), F.sum(F.when(~over, F.col("weight")))).first()
        if n == capped or not open_weight:
            break
        capped, level = n, (budget - (held or 0)) / open_weight
    target = F.least(F.col("weight") * F.lit(level), F.col("most").cast("double"))
    return table.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    repeats: int = 2,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    carry: bool = False,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, finish, shuffle_key.

    With `carry` the whole input row comes along as the struct `doc`.

    `taken` counts the words of the document in the mix, repeats included; `finish` is the virtual time of the
    document's first copy, null where the source's target is below one word. Ordering by (finish, shuffle_key) is the order of the mix.
    """
    key = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    rows = docs.select(
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if carry else []),
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        _queue(source),
        word_count(text).alias("size"),
        key.alias("shuffle_key"),
        F.conv(F.substring(key, 1, int(math.log(BUCKETS, 16))), 16, 10).cast("int").alias("bucket"),
    )
    narrow = written(rows.select("doc_id", "source", "queue", "size", "shuffle_key", "bucket"), "sizes")
    sums = written(narrow.groupBy("source", "queue", "bucket").agg(F.sum("size").alias("words")), "buckets")
    sizes = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sizes, weights, share, repeats)
    earlier = Window.partitionBy("queue").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0))).drop("source", "words")
    starts = written(starts.join(targets.select(_queue("source"), "source_size", "target"), "queue"), "starts")
    pieces = _pieces(repeats)
    last = _last_range(_placed(narrow, starts), pieces, targets)
    taken = sum((F.when(p["range"] <= last, p["words"]).otherwise(0) for p in pieces), F.lit(0))
    return _placed(rows if carry else narrow, starts).select(
        *(["doc"] if carry else []),
        "doc_id",
        "size",
        "source_size",
        "target",
        taken.cast("long").alias("taken"),
        F.try_divide(F.col("start") + F.col("size"), F.floor("target")).alias("finish"),
        "shuffle_key",
    )


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every document's rows as often as the mix takes it, range-sorted by virtual time.

    A row stands for a copy of which the mix takes at least half; texts stay whole.
    """
    rows = mix(docs, carry=True, **how)
    copies = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    rows = rows.where("taken > 0").withColumn("copies", copies).where("copies > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    finish = F.col("finish") + F.try_divide(F.col("copy") * F.col("source_size"), F.floor("target"))
    ordered = rows.withColumn("finish", finish).repartitionByRange("finish", "shuffle_key")
    return ordered.sortWithinPartitions("finish", "shuffle_key").select("doc.*")


def _queue(source: str) -> Column:
    """A key that keeps the null source apart from every text, so that plain equality joins serve."""
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")).alias("queue")


def _placed(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """Add `start`, the words queued in the document's source before it, and the source's columns."""
    within = Window.partitionBy("queue", "bucket").orderBy("shuffle_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(starts, ["queue", "bucket"])
    return placed.withColumn("start", F.col("before") + F.col("inside"))


def _pieces(repeats: int) -> list[dict[str, Column]]:
    """The pieces of a document's copies: words, and the range of virtual time they finish in."""
    goal = F.floor("target")
    out = []
    for copy in range(repeats):
        start = F.col("start") + F.col("source_size") * copy
        end = start + F.col("size")
        for low, high in ((start, F.least(end, goal)), (F.greatest(start, goal), end)):
            words = F.greatest(high - low, F.lit(0))
            range_ = F.when(goal <= 0, 2 * TIMES).otherwise(F.least(F.ceil(high * TIMES / goal), F.lit(2 * TIMES)))
            out.append({"words": words, "range": range_.cast("long")})
    return out


def _last_range(placed: DataFrame, pieces: list[dict[str, Column]], targets: DataFrame) -> int:
    """The last range of virtual time that the budget covers; ranges are few, so one task adds them up."""
    budget = targets.agg(F.sum(F.floor("target"))).first()[0] or 0
    each = placed.select(F.inline(F.array(*[F.struct(p["range"].alias("range"), p["words"].alias("words")) for p in pieces])))
    sums = each.where("words > 0").groupBy("range").agg(F.sum("words").alias("words"))
    running = sums.withColumn("total", F.sum("words").over(Window.orderBy("range")))
    return running.where(F.col("total") <= budget).agg(F.max("range")).first()[0] or 0
