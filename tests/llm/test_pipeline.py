import hashlib
import re

import corpus_pipeline as pipeline
from edges import documents, rows
from test_exact_dedup import brute as exact_brute
from test_mixing import brute as mix_brute
from test_ngram_join import brute as near_brute
from tokenizers import Tokenizer

import __spark_entry__ as entry_module
from panelweave.llm import language
from panelweave.llm.queries import held_out, vocabulary_path


def stages(spark, docs, sf_dir, tmp_path):
    """The output of every stage, written and read again."""
    out = []
    for i, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        out.append(docs)
    return out


def test_every_stage_matches_brute_force(spark, small_dir, tmp_path):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    known, exact, near, mixed, tokens = stages(spark, docs, small_dir, tmp_path)
    assert known.columns == exact.columns == near.columns == mixed.columns == docs.columns
    plain = lambda frame: [tuple(r) for r in frame.collect()]
    before = plain(docs)
    languages = language.predict(docs, language.fit(docs, ~held_out()))
    assert sorted(plain(known)) == sorted(tuple(r)[:5] for r in languages.where("lang_pred <> 'und' AND score >= 0.5").collect())
    assert {r[0] for r in before if re.search(r"[^\W\d_]", r[1] or "")} == {r[0] for r in plain(known)}
    assert sorted(r[0] for r in plain(exact)) == sorted(r[0] for r in exact_brute(plain(known)) if r[3])
    assert sorted(r[0] for r in plain(near)) == sorted(r[0] for r in near_brute([r[:2] for r in plain(exact)]) if r[0] == r[1])
    copies = [i for i, size, _, _, taken in mix_brute(plain(near)) for _ in range(int(taken / size + 0.5) if size else 0)]
    assert sorted(r[0] for r in plain(mixed)) == sorted(copies)
    library = Tokenizer.from_file(vocabulary_path())
    texts = {r[0]: r[1] for r in plain(mixed)}
    for r in tokens.collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run_is_the_last_stage(spark, small_dir, tmp_path):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    last = stages(spark, docs, small_dir, tmp_path)[-1]
    ran = entry_module.queries()["pipeline"](spark, small_dir)
    assert sorted(map(str, ran.collect())) == sorted(map(str, last.collect()))


def test_edge_rows_pass_every_stage(spark, small_dir, tmp_path):
    docs = documents(spark)
    out = stages(spark, docs, small_dir, tmp_path)
    assert all(o.columns == docs.columns for o in out[:-1])
    assert {r.doc_id for r in out[0].collect()} == {r[0] for r in rows() if re.search(r"[^\W\d_]", r[1] or "")}


def test_empty_table_passes_every_stage(spark, small_dir, tmp_path):
    assert [o.count() for o in stages(spark, documents(spark, []), small_dir, tmp_path)] == [0] * 5


def test_queries_are_registered():
    names = entry_module.queries()
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
