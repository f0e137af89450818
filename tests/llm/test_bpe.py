import random

import pytest
from edges import LONG, documents
from tokenizers import Tokenizer

from panelweave.llm import bpe
from panelweave.llm.queries import bpe_digests, vocabulary_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path())


@pytest.fixture(scope="module")
def ours():
    return bpe.vocabulary(vocabulary_path())


def same(library, ours, texts):
    flat, ends = ours.encode(texts)
    decoded = ours.decode(flat, ends).to_pylist()
    for i, expected in enumerate(library.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        got = flat[ends[i] : ends[i + 1]].tolist()
        assert got == expected.ids, texts[i]
        assert decoded[i] == library.decode(expected.ids, skip_special_tokens=False)


def test_random_texts(library, ours):
    draw = random.Random(5)
    alphabet = "aaabbc edéÉΣσςİı’'s'll\n\t0123!?.,-…ABC ßﬁ한가ก็👍🏽́\x1c\x1f\x85\xa0Ᲊ\U00010940"
    specials = ["", "<|endoftext|>", "<|startoftext|>x", "<|ENDOFTEXT|>", "<|endoftext|><|endoftext|>"]
    same(library, ours, ["".join(draw.choices(alphabet, k=draw.randint(0, 60))) + draw.choice(specials) for _ in range(3000)])


def test_every_character(library, ours):
    for base in range(0, 0x110000, 4096):
        same(library, ours, [f"a{c}B {c} {c}{c}'s" for c in map(chr, range(base, base + 4096, 7)) if not "\ud800" <= c < ""])


def test_long_words_and_texts(library, ours):
    same(library, ours, ["a" * 5000, "ab" * 3000, "the" * 3000, "", None, " ", LONG])


def test_documents(library, ours, medium_dir, spark):
    texts = [r.text for r in spark.read.parquet(f"{medium_dir}/documents.parquet").select("text").collect()]
    same(library, ours, texts)


def test_merges_one_at_a_time_where_later_ranks_interfere(tmp_path):
    # `ab` can be made late (rank 3) though a merge of `ab` ranks earlier (1): places must be taken from the left.
    import json

    alphabet = bpe._byte_alphabet()
    tokens = [*alphabet, *(c + "</w>" for c in alphabet), "aa", "aab", "aaaab", "aaa", "aaaa"]
    merges = [["aa", "aa"], ["a", "a"], ["aa", "a"]]
    tokens = list(dict.fromkeys(tokens))
    spec = {"added_tokens": [{"content": "<|x|>", "id": len(tokens)}], "model": {"type": "BPE", "vocab": {t: i for i, t in enumerate(tokens)}, "merges": merges,
            "end_of_word_suffix": "</w>"}, "pre_tokenizer": {"pretokenizers": [{"pattern": {"Regex": r"[\p{L}]+|[^\s\p{L}]+"}}]}}
    path = tmp_path / "v.json"
    path.write_text(json.dumps(spec))
    ours = bpe.Vocabulary(str(path))
    assert not ours.together[1]
    ids = spec["model"]["vocab"]

    def plain(word):
        parts = [*word[:-1], word[-1] + "</w>"]
        rank = {tuple(m): i for i, m in enumerate(merges)}
        while pairs := [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in rank]:
            i = min(pairs)[1]
            parts[i : i + 2] = ["".join(parts[i : i + 2])]
        return [ids[p] for p in parts]

    for n in range(1, 30):
        flat, _ = ours.encode(["a" * n])
        assert flat.tolist() == plain("a" * n)


def test_edge_rows_through_spark(spark, library):
    docs = documents(spark).select("doc_id", "text")
    encoded = bpe.encode(docs, vocabulary_path())
    for r in bpe.decode(encoded, vocabulary_path()).collect():
        expected = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == expected
        assert r.decoded == library.decode(expected, skip_special_tokens=False)
    both = {(r.doc_id, r.decoded): r.ids for r in bpe.encode_and_decode(docs, vocabulary_path()).collect()}
    assert both == {(r.doc_id, r.decoded): r.ids for r in bpe.decode(encoded, vocabulary_path()).collect()}
    odd = spark.createDataFrame([(1, None), (2, []), (3, [320, -5, 10**6, None, 320])], "doc_id long, ids array<int>")
    token = library.id_to_token(320)
    assert [r.decoded for r in bpe.decode(odd, vocabulary_path()).orderBy("doc_id").collect()] == ["", "", f"{token} {token}"]
    assert bpe_digests(documents(spark, []).select("doc_id", "text"), vocabulary_path()).count() == 0
