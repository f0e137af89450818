import json
import zlib
from pathlib import Path

import numpy as np
import pytest
from edges import documents, rows
from tokenizers import Tokenizer

from panelweave.llm import curve_packing, queries

PATH = queries.vocabulary_path(queries.PACKING_VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def check(pieces, texts, library):
    """Every id of every row lies in exactly one piece, and no sequence needs padding."""
    wanted = sorted((str(i), library.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in texts)
    by_sequence = {}
    for r in pieces:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    found = []
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == list(np.cumsum([0, *[r.length for r in parts]])[:-1])
        size = sum(r.length for r in parts)
        assert size <= 1024 and size & (size - 1) == 0
    # A row's pieces follow each other in its range, so rows that share an id are told apart by their starts.
    whole = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        ids = list(np.frombuffer(r.ids, "<u4"))
        assert len(ids) == r.length > 0
        if r.start == 0:
            assert str(r.doc_id) not in whole
            whole[str(r.doc_id)] = []
        whole[str(r.doc_id)] += ids
        assert len(whole[str(r.doc_id)]) == r.start + r.length
        if r.start + r.length == r.doc_tokens:
            found.append((str(r.doc_id), whole.pop(str(r.doc_id))))
    assert not whole and sorted(found) == wanted


@pytest.mark.parametrize("partitions", ["1", "5"])
def test_edge_rows(spark, settings, library, partitions):
    settings(spark__sql__shuffle__partitions=partitions)
    check(curve_packing.pack(documents(spark), PATH).collect(), [r[:2] for r in rows()], library)


def test_query_and_padding(spark, small_dir, library):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    pieces = curve_packing.pack(docs, PATH).collect()
    check(pieces, [(r.doc_id, r.text) for r in docs.collect()], library)
    digests = sorted((r.doc_id, r.start, r.length, zlib.crc32(r.ids), r.doc_tokens) for r in pieces)
    found = queries.QUERIES["op11_curve_packing"](spark, small_dir)
    assert found.columns == "doc_id start length ids_crc32 doc_tokens sequence_id offset".split()
    ranges = {r.doc_id: 0 for r in pieces}
    for r in found.collect():
        ranges[r.doc_id] += r.length
    assert ranges == {d[0]: d[4] for d in digests}
    assert {d for d in digests if d[1] == 0 and d[2] == d[4]} & {tuple(r)[:5] for r in found.collect()}


def test_empty_table(spark):
    pieces = curve_packing.pack(documents(spark, []), PATH)
    assert pieces.count() == 0 and curve_packing.sequences(pieces).count() == 0


def test_sequences_hold_the_pieces(spark, small_dir):
    pieces = curve_packing.pack(documents(spark), PATH)
    made = curve_packing.sequences(pieces).collect()
    assert all(len(r.ids) == r.n_tokens for r in made)
    assert sum(r.n_tokens for r in made) == sum(r.length for r in pieces.collect())
    short = spark.createDataFrame([(7, 5, 3, 0, np.arange(3, dtype="<u4").tobytes())], "sequence_id long, doc_id long, length long, offset long, ids binary")
    (row,) = curve_packing.sequences(short, pad=9).collect()
    assert row.n_tokens == 3 and row.doc_ids == [5] and row.ids == [0, 1, 2] + [9] * 1021


def test_one_group_of_equal_documents_spreads_over_ranges(spark, settings, library):
    settings(spark__sql__shuffle__partitions="4", spark__sql__adaptive__coalescePartitions__enabled="false")
    data = [(i, "same words in every document " * 3) for i in range(400)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(8)
    pieces = curve_packing.pack(docs, PATH).collect()
    check(pieces, data, library)
    assert len({r.sequence_id >> curve_packing.RANGE_BITS for r in pieces}) == 4


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (4, 2), (2, 5)])
def test_curve_visits_neighbours(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    keys = curve_packing.hilbert_key(grid, bits)
    assert sorted(keys) == list(range(len(grid)))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_neighbours_share_vocabulary(spark):
    draw = np.random.default_rng(1)
    topics = [[f"{a}{b}" for b in ("ing", "ton", "ware", "berg", "field", "wood")] for a in ("sand", "copper", "river", "window")]
    data = [(i, " ".join(draw.choice(topics[i % 4], 60))) for i in range(200)]
    pieces = curve_packing.pack(spark.createDataFrame(data, "doc_id long, text string"), PATH).collect()
    order = [r.doc_id % 4 for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)) if r.start == 0]
    assert np.mean([a == b for a, b in zip(order, order[1:], strict=False)]) > 0.6


def test_long_texts_in_stretches(library):
    text = "one  two three's\n four 12 5, x" * 50 + " <|endoftext|> a b" + "  \n tail"
    for size in (1, 7, 50, 10_000):
        parts = curve_packing.stretches(text, size)
        assert "".join(parts) == text
        assert [i for p in parts for i in library.encode(p, add_special_tokens=False).ids] == library.encode(text, add_special_tokens=False).ids
    assert curve_packing.stretches("x" * 100, 10) == ["x" * 100]


def test_tail_cuts():
    assert list(curve_packing.tail_cuts(700)) == [512, 640, 672, 688, 696, 700]
    assert list(curve_packing.tail_cuts(0)) == [] and list(curve_packing.tail_cuts(512)) == [512]


def test_ids_of_whole_texts(library):
    texts = ["one  two three's\n four\t12 5, x" * 9 + " <|endoftext|> a b" + "  \n tail ", "", " ", "a  b   c\x1c d\x85 e", "x" * 5000 + " y", "no <|endoftext|>"]
    flat, sizes = curve_packing.token_ids(texts, PATH)
    ends = np.cumsum(sizes)
    assert [list(flat[e - s : e]) for e, s in zip(ends, sizes, strict=True)] == [library.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    assert curve_packing.token_ids([], PATH)[0].size == 0


def test_fast_encoder_gives_the_library_ids(library, tmp_path):
    assert curve_packing._fast(PATH) is not None
    draw = np.random.default_rng(5)
    kinds = ["a", "Z", " ", "  ", "\n", "\t", "'s", "'LL", "7", "\u0664", "\u00e9", "e\u0301", "\u4e2d", "\u00a0", "\u3000", "\x1f", "\x85", "\U0001f600", "\u200d", "-", "#$", "\ufffd"]
    texts = ["".join(draw.choice(kinds, draw.integers(1, 80))) for _ in range(3000)]
    texts += [f"a{chr(c)}b {chr(c)}{chr(c)}1{chr(c)} " for c in range(1, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    texts += [" " * 2_000_000 + "x", "\n" * 999 + "y" + " " * 999, "xq" * 500_000, "-" * 500_000, "<|endoftext|>" * 3]
    found = curve_packing._encode(texts, PATH)
    wanted = library.encode_batch_fast(texts, add_special_tokens=False)
    assert all(a.tolist() == b.ids for a, b in zip(found, wanted, strict=True))


def test_other_vocabularies_stay_with_the_library(tmp_path):
    words = queries.vocabulary_path(queries.VOCABULARY)
    assert curve_packing._fast(words) is None
    own = Tokenizer.from_file(words)
    flat, _ = curve_packing.token_ids(["Some WORDS here"], words)
    assert list(flat) == [*own.encode("Some WORDS here", add_special_tokens=False).ids, 0]
    told = json.loads(Path(PATH).read_text())
    told["model"]["merges"][5], told["model"]["merges"][9] = told["model"]["merges"][9], told["model"]["merges"][5]
    swapped = tmp_path / "swapped.json"
    swapped.write_text(json.dumps(told))
    assert curve_packing._fast(str(swapped)) is None
