import random

import numpy as np

from ruleframe.llm import near_dup as nd


def brute(rows, percent):
    sets = [(i, set(nd.shingle_set(t).tolist())) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (a, x) in enumerate(sets):
        for b, y in sets[:n]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


def corpus(seed=5):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = [word() for _ in range(60)]
    rows = []
    for base in range(12):
        words = [word() for _ in range(rng.choice((6, 40, 120, 160)))]
        for _ in range(rng.choice((1, 2, 30))):
            copy = list(words)
            for _ in range(rng.choice((0, 0, 1, 2, 3, 6))):
                copy[rng.randrange(len(copy))] = word()
            rows.append(copy)
    rows += [passage + [word() for _ in range(rng.randrange(5, 90))] for _ in range(60)]
    rng.shuffle(rows)
    return [(i, " ".join(r)) for i, r in enumerate(rows)]


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_matches_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(nd.near_duplicates(docs)) == brute(rows, 85)
    # Short lists of one row put every pair through the long-list stage.
    assert rows_of(nd.near_duplicates(docs, short_list=1)) == brute(rows, 85)
    assert rows_of(nd.near_duplicates(docs, short_list=3, percent=80)) == brute(rows, 80)


def test_links_just_over_the_bound_are_found(spark):
    """Pairs of similarity 0.85 to 0.9, none of which shares words with another pair, and groups of up to 60 such copies."""
    rng = random.Random(11)
    rows, linked = [], []
    for pair in range(1200):
        words = [f"p{pair}w{i}" for i in range(rng.randrange(60, 200))]
        copies = 60 if pair % 300 == 0 else 1
        first = len(rows)
        rows.append(" ".join(words))
        for _ in range(copies):
            copy, x = list(words), set(nd.shingle_set(" ".join(words)).tolist())
            while True:
                changed = list(copy)
                changed[rng.randrange(len(copy))] = f"q{rng.randrange(10**9)}"
                y = set(nd.shingle_set(" ".join(changed)).tolist())
                if 100 * len(x & y) < 85 * len(x | y):
                    break
                copy = changed
            linked.append((first, len(rows)))
            rows.append(" ".join(copy))
    got = {r.doc_id: r.component_id for r in nd.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert [p for p in linked if got[p[0]] != got[p[1]]] == []


def test_ids_of_other_types(spark):
    docs = spark.createDataFrame([("b", "x y z"), ("a", "X y  z"), ("c", "other words here now then"), (None, "x y z")], "doc_id string, text string")
    got = sorted((tuple(r) for r in nd.near_duplicates(docs).collect()), key=str)
    assert got == sorted([("a", 1, "a", True), ("b", 1, "a", False), ("c", 1, "c", True), (None, 1, None, True)], key=str)


def test_components_of_a_long_chain(spark):
    n = 70
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(200, 201), (5, 5)], "a long, b long")
    got = {r.id: r.component for r in nd.components(links).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {200: 200, 201: 200}


def test_signature_estimates_similarity():
    a, b = np.arange(2000, dtype=np.uint64), np.arange(300, 2300, dtype=np.uint64)
    same = (nd.signature(nd.mix64(a), 512) == nd.signature(nd.mix64(b), 512)).mean()
    assert abs(same - 1700 / 2300) < 0.08


def test_odd_rows(spark, odd_docs, no_docs):
    got = [tuple(r) for r in nd.near_duplicates(odd_docs).collect()]
    assert len(got) == odd_docs.count()
    by = {r[0]: r for r in got if r[0] is not None}
    assert by[1] == (1, 0, 1, True) and by[2] == (2, 0, 2, True) and by[3] == (3, 0, 3, True)
    assert by[5] == (5, 1, 4, False) and by[7][2] == 6
    kept = nd.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 2, 3, 4, 6, 8, 9, 10]
    assert kept.where("doc_id is null").count() == 2
    assert nd.near_duplicates(no_docs).count() == 0


def test_matches_follow_the_similarity():
    from math import comb

    assert nd.matches_for(85) == 16 and nd.matches_for(80) == 14
    for percent in (50, 80, 85, 95):
        p, m = percent / 100, nd.matches_for(percent)
        assert m == 1 or sum(comb(32, i) * p**i * (1 - p) ** (32 - i) for i in range(m)) < 2e-6
