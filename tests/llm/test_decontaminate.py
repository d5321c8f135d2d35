import random

import numpy as np

from ruleframe.llm import decontaminate as dc


def plain_distance(p, t):
    """Least edit distance of p to any run of t, by the full table."""
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        nxt = [i]
        for j, b in enumerate(t, 1):
            nxt.append(min(row[j] + 1, nxt[-1] + 1, row[j - 1] + (a != b)))
        row = nxt
    return min(row), row.index(min(row))


def test_myers_equals_table():
    rng = random.Random(2)
    for _ in range(400):
        p = [rng.randrange(4) for _ in range(rng.randrange(1, 90))]
        t = [rng.randrange(4) for _ in range(rng.randrange(0, 120))]
        assert dc.myers(p, np.array(t, dtype=np.int64)) == plain_distance(p, t)


def test_pieces_cover():
    for m in range(1, 60):
        for k in range(m):
            cut = dc.pieces(m, k)
            assert len(cut) == k + 1 and cut[0][0] == 0 and all(n > 0 for _, n in cut)
            assert all(a + n == b for (a, n), (b, _) in zip(cut, cut[1:], strict=False)) and sum(cut[-1]) == m


def test_matches_brute_force(spark):
    rng = random.Random(8)
    word = lambda: f"v{rng.randrange(60)}"
    items = [(i, " ".join(word() for _ in range(rng.choice((2, 4, rng.randrange(3, 40)))))) for i in range(30)]
    rows = []
    for d in range(120):
        words = [word() for _ in range(rng.randrange(0, 150))]
        if rng.random() < 0.6:
            leak = dc.words_of(rng.choice(items)[1])
            leak = [w.decode() for w in leak]
            for _ in range(rng.randrange(0, 10)):
                at = rng.randrange(len(leak))
                leak[at : at + rng.randrange(2)] = [word() for _ in range(rng.randrange(2))]
                leak = leak or ["x"]
            at = rng.randrange(len(words) + 1)
            words[at:at] = leak
        rows.append((d, ", ".join(words)))
    want = set()
    for d, t in rows:
        for i, it in items:
            p, w = dc.words_of(it), dc.words_of(t)
            if p and w:
                best = plain_distance(p, w)[0]
                if best <= int(len(p) * dc.ERROR_RATE + 1e-9):
                    want.add((d, i, best))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, m.item_id, m.distance) for r in dc.contamination(docs, bench).collect() for m in r.matches}
    assert got == want and len(want) > 20
    blocks = dc.report(docs, bench, block_words=60).collect()
    assert {(r.doc_id, i) for r in blocks for i in r["items"]} == {x[:2] for x in want}
    assert len(blocks) == len(rows)
    clean = {d for d, _ in rows} - {x[0] for x in want}
    assert {r.doc_id for r in dc.keep_clean(docs, bench).collect()} == clean


def test_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (4, "no id at all here"), (4, "no id at all here")], "item_id long, text string")
    got = dc.report(odd_docs, bench)
    assert got.count() == odd_docs.count()
    # "one two" is an item of two words: exact matches only; repeated rows and the null id count each for itself.
    want = [(4, [3]), (5, [3]), (5, [3]), (None, [4])]
    found = lambda df: sorted(((r.doc_id, r["items"]) for r in df.where("contaminated").collect()), key=str)
    assert found(got) == sorted(want, key=str)
    blocks = dc.report(odd_docs, bench, block_words=2)
    assert blocks.count() == odd_docs.count() and found(blocks) == sorted(want, key=str)
    assert dc.keep_clean(odd_docs, bench).columns == odd_docs.columns
    assert dc.report(no_docs, bench).count() == 0
    assert dc.report(odd_docs, bench.where("false")).where("contaminated").count() == 0


def test_short_items_and_unspaced_scripts(spark):
    docs = spark.createDataFrame([(1, "so a b c d it is"), (2, "a b x c d"), (3, "前文今天天气很好我们去公园后文"), (4, "今天天气好我们公园")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "a b c d"), (8, "今天天气很好我们去公园")], "item_id smallint, text string")
    got = {r.doc_id: r["items"] for r in dc.report(docs, bench).where("contaminated").collect()}
    assert got == {1: [7], 3: [8], 4: [8]}
    assert dc.words_of("ab 天气c") == ["ab".encode(), "天".encode(), "气".encode(), b"c"]
