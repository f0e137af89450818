import random

from edges import BASE, COLUMNS, documents, rows

from panelweave.llm import linking, ngram_join


def gram_set(text, n=5):
    words = (text or "").lower().split()
    size = min(n, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def brute(data, threshold=0.8):
    """(doc_id, class_id, n_links) of (doc_id, text) rows, ids may be null."""
    sets = [gram_set(t) for _, t in data]
    n = len(data)
    links = [[j for j in range(n) if j != i and sets[i] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])] for i in range(n)]
    # Byte-equal texts without words share a class, but have no links.
    same = [[j for j in range(n) if (data[j][1] or "") == (data[i][1] or "")] for i in range(n)]
    out = []
    for i in range(n):
        seen, stack = {i}, [i]
        while stack:
            x = stack.pop()
            for y in links[x] + same[x]:
                if y not in seen:
                    seen.add(y)
                    stack.append(y)
        ids = [data[j][0] for j in seen if data[j][0] is not None]
        out.append((data[i][0], min(ids) if ids else None, len(links[i])))
    return sorted(out, key=str)


def found(frame):
    return sorted((tuple(r) for r in ngram_join.find_similar(frame).select("doc_id", "class_id", "n_links").collect()), key=str)


def near_copies(seed, groups=12, size=8):
    draw, data = random.Random(seed), []
    for g in range(groups):
        words = [f"w{draw.randrange(500)}" for _ in range(draw.randint(3, 120))]
        for _ in range(size):
            copy = list(words)
            for _ in range(draw.randint(0, 3)):
                copy[draw.randrange(len(copy))] = f"x{draw.randrange(9)}"
            data.append((len(data), " ".join(copy)))
    draw.shuffle(data)
    return data


def test_band_choice_reaches_the_recall():
    for threshold in (0.5, 0.8, 0.95):
        bands, per_band = ngram_join.choose_bands(threshold)
        assert bands * per_band <= ngram_join.MAX_HASHES
        assert threshold < 0.8 or 1 - (1 - threshold**per_band) ** bands >= ngram_join.RECALL


def test_matches_brute_force_on_near_copies(spark):
    data = near_copies(1)
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    assert found(frame) == brute(data)


def test_blocks_and_stripes_change_nothing(spark, monkeypatch):
    data = near_copies(2, groups=3, size=40)
    monkeypatch.setattr(linking, "BLOCK", 8)
    assert found(spark.createDataFrame(data, "doc_id long, text string")) == brute(data)


def test_matrix_of_overlaps_in_stripes(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(ngram_join, "STRIPE", 7)
    draw = random.Random(4)
    sets = [sorted({draw.randrange(60) for _ in range(draw.randint(1, 50))}) for _ in range(30)]
    a, b = pd.DataFrame({"grams": sets[:18]}), pd.DataFrame({"grams": sets[18:]})
    for left, right, own in ((a, b, False), (a, a, True)):
        got = ngram_join.similar_sets(0.4)(left, left if own else right)
        expected = [[len(set(x) & set(y)) >= 0.4 * len(set(x) | set(y)) for y in right["grams"]] for x in left["grams"]]
        assert got.tolist() == expected


def test_edge_rows(spark):
    frame = documents(spark)
    data = [(r[0], r[1]) for r in rows()]
    assert found(frame) == brute(data)
    kept = ngram_join.keep_one(frame)
    assert kept.columns == frame.columns
    # Texts without words are classes of byte-equal texts: 4, 5 and the null id (smallest id 4); 6 alone.
    assert sorted({r.doc_id for r in kept.collect() if r.doc_id is not None}) == [1, 4, 6, 7, 9, 10]


def test_common_passage_alone_links_nothing(spark):
    passage = BASE * 3
    data = [(i, " ".join(f"own{i}x{j}" for j in range(200)) + " " + passage) for i in range(60)]
    frame = spark.createDataFrame(data, "doc_id long, text string")
    assert {r.n_links for r in ngram_join.find_similar(frame).collect()} == {0}
    assert ngram_join.keep_one(frame).count() == 60


def test_hot_copies_and_empty_table(spark):
    data = [(i, BASE if i % 3 else f"{BASE} {i} " * 3) for i in range(300)]
    result = ngram_join.find_similar(spark.createDataFrame(data, "doc_id long, text string"))
    assert result.where("doc_id % 3 <> 0 AND n_links = 199 AND class_id = 1").count() == 200
    assert ngram_join.find_similar(spark.createDataFrame([], COLUMNS)).count() == 0
