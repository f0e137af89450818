import hashlib
import re
from collections import defaultdict

from edges import documents, rows

from panelweave.llm import exact_dedup


def brute(data):
    groups = defaultdict(list)
    for r in data:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append(r)
    out = []
    for text, members in groups.items():
        head = min(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        sha, first = hashlib.sha256(text.encode()).hexdigest(), True
        for r in sorted(members, key=lambda r: r is not head):
            out.append((r[0], head[0], len(members), r is head and first, sha))
            first = first and r is not head
    return sorted(out, key=str)


def test_matches_brute_force_on_edge_rows(spark):
    found = exact_dedup.find_copies(documents(spark)).collect()
    assert sorted(map(tuple, found), key=str) == brute(rows())


def test_kept_rows_keep_all_columns(spark):
    frame = documents(spark)
    kept = exact_dedup.drop_copies(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([b[0] for b in brute(rows()) if b[3]], key=str)


def test_empty_table(spark):
    empty = documents(spark, [])
    assert exact_dedup.find_copies(empty).count() == 0
    assert exact_dedup.drop_copies(empty).count() == 0


def test_one_text_in_most_rows(spark):
    data = [(i, "same text" if i % 3 else f"own {i}") for i in range(3000)]
    found = exact_dedup.find_copies(spark.createDataFrame(data, "doc_id long, text string").repartition(7))
    assert found.where("kept").count() == 1001
    assert found.where("group_size = 2000 AND keep_id = 1").count() == 2000


def test_filter_too_small_for_the_rows_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "filter_bits", lambda rows: 10)
    data = [(i, f"text {i // 2}") for i in range(4000)]
    found = exact_dedup.find_copies(spark.createDataFrame(data, "doc_id long, text string"))
    assert found.where("kept AND group_size = 2").count() == 2000
