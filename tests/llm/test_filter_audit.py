import re
from itertools import permutations

import numpy as np
import pytest
from edges import documents, rows

from panelweave.llm import filter_audit

LABELS = "doc_id long, quality int, toxic int, mask int, good string"


def brute(docs, labels):
    """Every order applied to every document, one after the other."""
    good = {r[0] for r in labels if r[0] is not None and r[1] == 1}
    toxic = {r[0] for r in labels if r[0] is not None and r[2] == 1}
    whole = [(i, text or "", lang or "") for i, text, lang in docs]
    fails = []
    for i, text, _ in whole:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        copy = any(t == text and j is not None and (i is None or j < i) for j, t, _ in whole)
        capitals = len(re.findall("[A-Z]", text))
        fails.append({
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * capitals > 10 * len(text),
            "D": re.search("[#$%&*|]", text) is not None, "E": copy,
        })
    out = {}
    for part in {p for _, _, p in whole}:
        mine = [(i, f) for (i, _, p), f in zip(whole, fails, strict=True) if p == part]
        for order in permutations("ABCDE"):
            left = mine
            gone = []
            for step, name in enumerate(order, 1):
                lost = [m for m in left if m[1][name]]
                left = [m for m in left if not m[1][name]]
                out[part, "".join(order), step] = [
                    len(left), len(lost), sum(f[name] for _, f in gone), sum(f[name] and sum(f.values()) == 1 for _, f in mine),
                    sum(i in good for i, _ in lost), sum(i in toxic for i, _ in lost),
                ]
                gone += lost
        for name in "ABCDE":
            at = [k for k in out if k[0] == part and k[1][k[2] - 1] == name]
            shapley = sum(out[k][1] for k in at)
            for k in at:
                out[k].append(shapley)
    return out


def audited(docs, labels):
    return {(r.part, r.filter_order, r.step): list(r)[3:] for r in filter_audit.audit(docs, labels).collect()}


def test_edge_rows(spark):
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (7, 1, 1), (None, 1, 1), (99, 1, 1), (4, None, None)]
    extra = [(10 + i, t, lang, "x", None, 1, True, "h", 2, "k", 3) for i, (t, lang) in enumerate(
        [("SHOUTED WORDS #1", "en"), ("SHOUTED WORDS #1", "de"), (None, ""), ("word " * 200, "en"), ("a|b " + "c%d " * 120, None)])]
    data = [*rows(), *extra]
    table = spark.createDataFrame([(*r, 5, "g") for r in labels], LABELS)
    found = audited(documents(spark, data).repartition(3), table)
    assert found == brute([(r[0], r[1], r[2]) for r in data], labels)
    assert len(found) == 600 * len({r[2] or "" for r in data})


def test_tables(spark, small_dir):
    docs, labels = (spark.read.parquet(f"{small_dir}/{name}.parquet") for name in ("documents", "labels"))
    plain = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    assert audited(docs, labels) == brute(plain, [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])


def test_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(documents(spark, []), none).count() == 0
    found = audited(documents(spark), none)
    assert len(found) == 600 * 3 and all(counts[4] == counts[5] == 0 for counts in found.values())


def test_other_filters(spark):
    data = [("p", m, 1, 0) for m in (0, 1, 2, 3, 3)]
    found = filter_audit.audit_masks(spark.createDataFrame(data, "part string, mask int, good long, toxic long"), "XY")
    assert {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in found.collect()} == {
        ("XY", 1): (2, 3, 0, 1, 4), ("XY", 2): (1, 1, 2, 1, 4), ("YX", 1): (2, 3, 0, 1, 4), ("YX", 2): (1, 1, 2, 1, 4),
    }
    with pytest.raises(ValueError):
        filter_audit.audit_masks(spark.createDataFrame(data, "part string, mask int, good long, toxic long"), "ABCDEFGH")


def test_min_plus_product():
    draw = np.random.default_rng(1)
    fails, orders = draw.random((40, 5)) < 0.4, np.array(list(permutations(range(5))))
    ranks = filter_audit.removal_ranks(fails, np.argsort(orders, axis=1).T)
    for m, mask in enumerate(fails):
        for o, order in enumerate(orders):
            assert ranks[m, o] == next((s for s, f in enumerate(order) if mask[f]), 5)
