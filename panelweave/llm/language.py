"""Language identification: multinomial naive Bayes over hashed character n-grams.

Words are runs of letters, lower-cased and padded with one blank on either side; features are their n-grams
of one to three characters, hashed into `BUCKETS` counters. The matrix of log-probabilities (languages x
buckets) is broadcast: its size is fixed by the number of languages, not by the corpus. Batches are scored
in numpy by gathering the matrix columns of all n-grams and summing them per document.

The model is fitted on a bounded sample: in expectation at most `TRAINING_ROWS` labelled rows of each
language, chosen by a hash of the id, so reruns agree. Every document is scored over its whole text.

Null texts and texts without a letter are `und` with score 0, as is everything when no row has a label.
The score is the posterior probability of the predicted language, all languages being equally likely before the
text is read; ties go to the smaller language name. Repeated rows are scored each, an empty table gives no rows,
and a column that has the name of a new one is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.llm.batches import Batches, bounded, map_batches, other_fields

BUCKETS = 1 << 15
TRAINING_ROWS = 10_000
SMOOTHING = 0.5
# Characters handled at once in numpy; a single longer text is cut between words.
CHUNK = 1 << 18
# Bytes of text taken from Spark's batches at once.
BYTES = 1 << 21
UNDETERMINED = "und"
_MIXERS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _pieces(text: str) -> Iterator[str]:
    """The text in parts of about CHUNK characters, cut at white space only."""
    start = 0
    while len(text) - start > CHUNK:
        end = start + CHUNK
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[start:end]
        start = end
    yield text[start:]


def ngram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed n-grams of all texts, and for each the index of its text."""
    codes = np.frombuffer("\x00".join([*texts, ""]).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    # Lower-casing can lengthen a text, so texts are told apart by their separators.
    owner = np.cumsum(codes == 0, dtype=np.int64) - (codes == 0)
    letter = _letters()[codes]
    before = np.concatenate(([False], letter[:-1]))
    keep = letter | before
    codes, owner, letter = np.where(letter, codes, 32)[keep].astype(np.uint64), owner[keep], letter[keep]
    codes = np.concatenate((np.array([32], np.uint64), codes))
    owner, letter = np.concatenate((owner[:1] if len(owner) else [0], owner)), np.concatenate(([False], letter))
    found, owners = [letter_buckets(codes, 1)[letter]], [owner[letter]]
    if len(codes) > 2:
        # An n-gram holds a letter and no inner blank; a blank may end the text before, so letters tell the owner.
        inside = letter[:-1] | letter[1:]
        found.append(letter_buckets(codes, 2)[inside])
        owners.append(np.where(letter[:-1], owner[:-1], owner[1:])[inside])
        found.append(letter_buckets(codes, 3)[letter[1:-1]])
        owners.append(owner[1:-1][letter[1:-1]])
    return np.concatenate(found), np.concatenate(owners)


def letter_buckets(codes: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each place."""
    mixed = np.full(len(codes) - n + 1, n, np.uint64)
    for i in range(n):
        mixed = (mixed ^ codes[i : len(codes) - n + 1 + i]) * _MIXERS[i]
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * _MIXERS[0]) >> np.uint64(64 - (BUCKETS.bit_length() - 1))).astype(np.int64)


def _groups(texts: list[str | None]) -> Iterator[tuple[list[str], list[int]]]:
    """Pieces of texts with the index of their text, about CHUNK characters at a time."""
    parts: list[str] = []
    at: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        for piece in _pieces((text or "").replace("\x00", " ")):
            parts.append(piece)
            at.append(i)
            size += len(piece)
            if size >= CHUNK:
                yield parts, at
                parts, at, size = [], [], 0
    if parts:
        yield parts, at


def fit(docs: DataFrame, trainable: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities) from rows where `trainable` holds and the language is not null."""
    spark = docs.sparkSession
    labelled = docs.where(trainable & F.col(lang).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(doc_id).alias("id")
    )
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], np.zeros((0, BUCKETS), np.float32)
    languages = sorted(counts)
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, TRAINING_ROWS / n))]), F.col("lang"))
    drawn = F.pmod(F.xxhash64(F.lit("train"), "id"), F.lit(1 << 20)) < share * (1 << 20)
    place = {k: i for i, k in enumerate(languages)}

    def count(batches: Batches) -> Batches:
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in bounded(batches, "text", BYTES):
            names, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for parts, at in _groups(texts):
                buckets, owner = ngram_buckets(parts)
                row = np.array([place[names[i]] for i in at], np.int64)[owner]
                total += np.bincount(row * BUCKETS + buckets, minlength=total.size).reshape(total.shape)
        row, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(bucket, pa.int32()), pa.array(total[row, bucket])], ["row", "bucket", "n"])

    sample = labelled.where(drawn).select("lang", "text").repartition(16)
    counted = map_batches(sample, count, "row int, bucket int, n long").groupBy("row", "bucket").agg(F.sum("n").alias("n")).toPandas()
    total = np.full((len(languages), BUCKETS), SMOOTHING)
    np.add.at(total, (counted["row"].to_numpy(), counted["bucket"].to_numpy()), counted["n"].to_numpy())
    return languages, np.log(total / total.sum(axis=1, keepdims=True)).astype(np.float32)


def predict_batch(texts: list[str | None], languages: list[str], matrix: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Predicted language and posterior probability of each text; `matrix` is buckets x languages."""
    sums = np.zeros((len(texts), max(1, len(languages))))
    grams = np.zeros(len(texts), np.int64)
    if languages:
        for parts, at in _groups(texts):
            buckets, owner = ngram_buckets(parts)
            mine = np.asarray(at, np.int64)[owner]
            grams += np.bincount(mine, minlength=len(texts))
            for k in range(len(languages)):
                sums[:, k] += np.bincount(mine, weights=matrix[buckets, k], minlength=len(texts))
    best = sums.argmax(axis=1)
    posterior = 1.0 / np.exp(np.maximum(sums - sums.max(axis=1, keepdims=True), -700)).sum(axis=1)
    known = grams > 0
    return [languages[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)], np.where(known, posterior, 0.0)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", prediction: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the two columns to every row, in place of any of their names; all other columns pass through."""
    languages, log_probabilities = model
    shared = docs.sparkSession.sparkContext.broadcast((languages, np.ascontiguousarray(log_probabilities.T)))
    kept = other_fields(docs, [prediction, score])
    kinds = T.StructType([*kept, T.StructField(prediction, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Batches) -> Batches:
        names_of, matrix = shared.value
        for batch in bounded(batches, text, BYTES):
            found, posterior = predict_batch(batch.column(text).to_pylist(), names_of, matrix)
            rest = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(found, pa.string()), pa.array(posterior, pa.float64())], kinds.names)

    return map_batches(docs, run, kinds)
