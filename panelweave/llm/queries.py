"""The registered queries of the operators: production parameters over whole tables."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm import (
    archives, bpe, curve_packing, exact_dedup, filter_audit, language, license_scan,
    mixing, ngram_join, pseudonyms, url_trust, vector_codes, vector_dedup,
)

# The vocabularies' place is a parameter; the files are never part of the repository.
TOKENIZERS = os.environ.get("TOKENIZER_DIR")
VOCABULARY = "word_bpe_49k.json"
PACKING_VOCABULARY = "byte_bpe_50k.json"
URL_RULES = tuple(
    url_trust.Rule(*rule)
    for rule in (
        ("allow", "org", "/"),
        ("block", "example.org", "/es/"),
        ("block", "example.org", "/en/1"),
        ("allow", "com", "/fr/"),
        ("block", "com", "/de/"),
    )
)
# Only a stand-in: whoever holds the key can undo the pseudonyms, so a deployment passes its own.
PSEUDONYM_KEY = os.environ.get("PSEUDONYM_KEY", "public demonstration key").encode()


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str = VOCABULARY) -> str:
    return os.path.join(TOKENIZERS, name) if TOKENIZERS else public_tokenizers.path(name)


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that language models never learn from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def op1_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trust.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.find_near(_table(spark, sf_dir, "embeddings"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a folder per source and thousand ids, every tenth document the folder's licence file."""
    docs = _table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("LICENSE-"), "doc_id")).otherwise(F.concat("doc_id", F.lit(".txt")))
    path = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 1000).cast("string"), name)
    found = license_scan.scan(docs.select("doc_id", "text", path.alias("path")), "doc_id", "path", "text")
    return found.withColumnRenamed("file_id", "doc_id")


def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(docs, PSEUDONYM_KEY).withColumn("n_spans", F.size("spans").cast("long"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode `text`; the other columns, ids, n_tokens and the digests of ids and decoded text.

    Input columns with the name of a new one are replaced.
    """
    made = ("text", "ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256")
    rest = [c for c in docs.columns if c.lower() not in made]
    decoded = bpe.encode_and_decode(docs, path)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select(
        *[F.col(f"`{c}`") for c in rest],
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_digests(docs, vocabulary_path()).drop("ids")


def op7_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.find_similar(docs).select("doc_id", "class_id", "n_links", "kept")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_copies(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.archived_pages(_table(spark, sf_dir, "pages"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.fit(docs.select("doc_id", "text", "lang"), ~held_out())
    found = language.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op11_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = curve_packing.pack(docs, vocabulary_path(PACKING_VOCABULARY))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_verdicts,
        op2_near_vectors,
        op3_license_scan,
        op4_pseudonyms,
        op5_source_mix,
        op6_bpe_round_trip,
        op7_ngram_links,
        op8_exact_dedup,
        op9_archives,
        op10_language_id,
        op11_curve_packing,
        op12_vector_codes,
        op13_filter_audit,
    )
}
