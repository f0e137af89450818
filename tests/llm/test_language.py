from edges import LONG, documents
from pyspark.sql import functions as F

from panelweave.llm import language
from panelweave.llm.queries import held_out


def test_held_out_accuracy_and_rerun(spark, medium_dir):
    docs = spark.read.parquet(f"{medium_dir}/documents.parquet")
    model = language.fit(docs, ~held_out())
    again = language.fit(docs, ~held_out())
    assert (model[1] == again[1]).all()
    found = language.predict(docs.withColumn("held", held_out()), model).where("held AND lang IS NOT NULL")
    right, total = found.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert total > 100 and right / total > 0.97


def test_model_never_sees_held_out_rows(spark):
    data = [(i, "abc def", "aa") if i % 2 else (i, "xyz uvw", "bb") for i in range(100)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    languages, _ = language.fit(docs, F.col("doc_id") % 2 == 1)
    assert languages == ["aa"]


def test_edge_rows(spark):
    docs = documents(spark)
    found = language.predict(docs, language.fit(docs, F.lit(True)))
    assert found.columns == [*docs.columns, "lang_pred", "score"]
    by_id = {(r.doc_id, r.text): r for r in found.collect()}
    assert len(found.collect()) == docs.count()
    for r in by_id.values():
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))


def test_without_labels_or_rows(spark):
    docs = documents(spark)
    none = language.fit(docs, F.lit(False))
    assert {r.lang_pred for r in language.predict(docs, none).collect()} == {"und"}
    empty = documents(spark, [])
    assert language.predict(empty, language.fit(empty, F.lit(True))).count() == 0


def test_pieces_of_a_long_text_give_the_same_features(monkeypatch):
    whole, _ = language.ngram_buckets([LONG])
    monkeypatch.setattr(language, "CHUNK", 1000)
    cut = [b for parts, _ in language._groups([LONG]) for b in language.ngram_buckets(parts)[0]]
    assert sorted(cut) == sorted(whole)


def test_features_do_not_cross_texts():
    alone = [sorted(language.ngram_buckets([t])[0]) for t in ("one two", "", "3 4", "drei")]
    buckets, owner = language.ngram_buckets(["one two", "", "3 4", "drei"])
    assert [sorted(buckets[owner == i]) for i in range(4)] == alone


def test_training_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "TRAINING_ROWS", 50)
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("word").alias("text"), F.lit("en").alias("lang"))
    languages, matrix = language.fit(docs, F.lit(True))
    assert languages == ["en"] and matrix.shape == (1, language.BUCKETS)
