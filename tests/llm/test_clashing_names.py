"""Input columns with the names of new ones are replaced; all columns of every result are read."""

import corpus_pipeline as pipeline
import pytest
from edges import clashing, documents, rows

from panelweave.llm import bpe, exact_dedup, language, mixing, ngram_join, pseudonyms
from panelweave.llm.queries import bpe_digests, held_out, vocabulary_path

KEY = b"k"


def plain(frame):
    return sorted(map(str, frame.collect()))


def digests(docs):
    return bpe_digests(docs, vocabulary_path())


def predicted(docs):
    return language.predict(docs, language.fit(docs, ~held_out()))


@pytest.mark.parametrize(
    ("run", "made"),
    [
        (predicted, ["lang_pred", "score"]),
        (lambda docs: pseudonyms.pseudonymise(docs, KEY), ["text", "spans"]),
        (lambda docs: bpe.encode(docs, vocabulary_path()), ["ids"]),
        (lambda docs: bpe.decode(bpe.encode(docs, vocabulary_path()), vocabulary_path()), ["ids", "decoded"]),
        (lambda docs: bpe.encode_and_decode(docs, vocabulary_path()), ["ids", "decoded"]),
        (digests, ["ids", "n_tokens", "ids_sha256", "decoded_sha256"]),
    ],
)
def test_new_columns_replace_old_ones(spark, run, made):
    found = run(clashing(spark))
    names = [c.lower() for c in found.columns]
    assert len(names) == len(set(names)) and set(made) <= set(names)
    assert plain(found.select("doc_id", *made)) == plain(run(documents(spark)).select("doc_id", *made))
    assert len(plain(found)) == len(rows())
    assert run(clashing(spark, [])).count() == 0


@pytest.mark.parametrize("run", [exact_dedup.drop_copies, ngram_join.keep_one, mixing.mixed, mixing.mix, exact_dedup.find_copies, ngram_join.find_similar])
def test_other_operators_read_no_clashing_column(spark, run):
    found = run(clashing(spark))
    assert sorted(str(r.doc_id) for r in found.collect()) == sorted(str(r.doc_id) for r in run(documents(spark)).collect())
    assert run(clashing(spark, [])).count() == 0


@pytest.mark.parametrize("stage", range(5))
def test_stages(spark, stage):
    name, run = pipeline.STAGES[stage]
    found = run(spark, clashing(spark), "")
    assert len(plain(found)) > 0
    if stage < 4:
        assert found.columns == clashing(spark).columns


def test_wordless_sources_and_repeated_rows(spark):
    data = [(1, "a b c", "x"), (1, "a b c", "x"), (2, "", "blank"), (3, None, "blank"), (4, " ", None), (5, "one word each " * 9, "y")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    found = mixing.mix(docs).collect()
    assert len(found) == len(data)
    assert {r.doc_id: (r.size, r.taken, r.finish) for r in found if r.doc_id in (2, 3, 4)} == {i: (0, 0, None) for i in (2, 3, 4)}
    assert {r.doc_id for r in mixing.mixed(docs).collect()} <= {1, 5}
    assert mixing.mix(docs.where("doc_id IN (2, 3, 4)")).count() == 3 and mixing.mixed(docs.where("doc_id = 2")).count() == 0


def test_repeated_rows_are_scored_and_replaced_each(spark):
    docs = spark.createDataFrame([(1, "call 4111 1111 1111 1111 now", "en")] * 3, "doc_id long, text string, lang string")
    assert len(set(map(str, pseudonyms.pseudonymise(docs, KEY).collect()))) == 1
    assert [r.lang_pred for r in predicted(docs).collect()] == ["en"] * 3


def test_tied_copies_leave_one(spark):
    data = [(1, "a b", "p"), (1, "a b", "q"), (1, "a\tb", "r"), (2, "ab", "s"), (None, "c", "t"), (None, "c", "u"), (3, "lone", "v")]
    docs = spark.createDataFrame(data, "doc_id long, text string, tag string").repartition(3)
    assert sorted((str(r.doc_id), r.text.replace("\t", " ")) for r in exact_dedup.drop_copies(docs).collect()) == [("1", "a b"), ("3", "lone"), ("None", "c")]
