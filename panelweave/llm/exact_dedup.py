"""Exact copies by two-pass Bloom filtering.

Pass one counts the filter slots of all text hashes and keeps the slots hit twice. Pass two tests every row
against that filter, which is broadcast with a fixed size bound: a row that fails is the only one with its
text and passes straight through; only possibly repeated rows are shuffled and grouped by digest.

Texts are equal when identical after deleting the six ASCII white-space characters. Null texts count as
empty. Among equal texts the one with the most code points stays, then the smallest id (null ids last); of
rows that tie in all of this exactly one stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.membership import filter_bits, filter_words, with_membership
from panelweave.llm.storage import written
from panelweave.operators.skew import attach_groups


def text_digest(text: str) -> Column:
    """Lower-case hex SHA-256 of the text without white space."""
    return F.sha2(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", ""), 256)


def _order(length: Column, doc_id: Column) -> Column:
    return F.struct((-length).alias("longest"), doc_id.isNull().alias("no_id"), doc_id.alias("id"))


def find_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = written(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            text_digest(text).alias("text_sha256"),
            F.coalesce(F.length(text), F.lit(0)).alias("length"),
        )
        .withColumn("hash", F.xxhash64("text_sha256"))
        .withColumn("row", F.monotonically_increasing_id()),
        "digests",
    )
    bits = filter_bits(rows.count())
    words = filter_words(rows, "hash", bits, at_least=2)
    tested = with_membership(rows, "hash", words, bits, "repeated")
    alone = tested.where(~F.col("repeated")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    repeated = tested.where("repeated")
    order = F.struct(_order(F.col("length"), F.col("doc_id")).alias("order"), "row")
    groups = repeated.groupBy("text_sha256").agg(F.count("*").alias("group_size"), F.min(order).alias("first"))
    grouped = attach_groups(repeated, groups, ["text_sha256"]).select(
        "doc_id", F.col("first.order.id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256"
    )
    return alone.unionByName(grouped)


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; only possibly repeated rows are shuffled.

    Groups are decided on a written narrow table. Whole rows are then tested by their id alone against a filter of
    the ids in groups; those that pass are hashed once more and meet their group's first row.
    """
    order = _order(F.coalesce(F.length(text), F.lit(0)), F.col(doc_id))
    narrow = docs.select(_id_hash(doc_id), order.alias("order"), text_digest(text).alias("sha")).withColumn("hash", F.xxhash64("sha"))
    narrow = written(narrow, "digests")
    bits = filter_bits(narrow.count())
    repeated = with_membership(narrow, "hash", filter_words(narrow, "hash", bits, at_least=2), bits, "repeated").where("repeated")
    equal = repeated.groupBy("sha", "order").agg(F.count("*").alias("n"), F.min("id_hash").alias("id_hash"))
    groups = equal.groupBy("sha").agg(F.sum("n").alias("copies"), F.min("order").alias("first"))
    groups = written(groups.where("copies > 1").select("sha", "first"), "groups")
    members = written(attach_groups(equal, groups, ["sha"], "inner"), "members")
    bits = filter_bits(members.count())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), _id_hash(doc_id), F.col(text).alias("text"), order.alias("order"))
    tested = with_membership(rows, "id_hash", filter_words(members, "id_hash", bits), bits, "grouped")
    some = tested.where("grouped").select("doc", "order", text_digest("text").alias("sha"))
    # A row outside all groups only passed by its id; of a group, the first row stays.
    met = attach_groups(some, groups, ["sha"]).where(F.col("first").isNull() | F.col("order").eqNullSafe(F.col("first")))
    tied = members.where((F.col("n") > 1) & F.col("order").eqNullSafe(F.col("first"))).select("sha", F.lit(True).alias("tied"))
    winners = written(attach_groups(met, tied, ["sha"]).select("doc", "sha", "tied"), "winners")
    # Of rows that tie in id and length one stays; no other whole row is sorted.
    one = winners.where("tied").dropDuplicates(["sha"]).select("doc")
    kept = winners.where("tied IS NULL").select("doc").unionByName(one)
    return tested.where(~F.col("grouped")).select("doc").unionByName(kept).select("doc.*")


def _id_hash(doc_id: str) -> Column:
    return F.xxhash64(F.lit("id"), F.col(doc_id)).alias("id_hash")
