import hashlib
import random
from collections import Counter

import numpy as np

from ruleframe.llm import line_dedup as ld


def brute(rows, least):
    keys = [{k for k in map(ld.line_key, ld.lines_of(t)) if k} for _, t in rows]
    repeated = {k for k, n in Counter(k for ks in keys for k in ks).items() if n >= least}
    out = []
    for i, t in rows:
        lines = ld.lines_of(t)
        kept = [x for x in lines if ld.line_key(x) not in repeated]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_matches_brute_force_both_ways(spark):
    rng = random.Random(3)
    pool = [f" Line {i} \t" if i % 2 else f"LINE {i}" for i in range(40)]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"own {i} {j}" for j in range(rng.randrange(6)))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows, 10)
    assert any(w[2] for w in want)
    assert rows_of(ld.digest(ld.drop_repeated_lines(docs))) == want
    assert rows_of(ld.digest(ld.drop_repeated_lines(docs, broadcast_bytes=0))) == want
    # A filter that is far too small only sends more lines to the exact stage.
    assert rows_of(ld.digest(ld.drop_repeated_lines(docs, filter_bits=10))) == want


def test_filter_has_no_false_negatives(spark):
    rows = [(i, f"line {i // 2}\nalone {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    twice = ld.filter_array(ld.repeat_filter(docs, bits=16), 16)
    at = ld.positions([f"line {i}".encode() for i in range(200)], 16)
    assert ((twice[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all()


def test_first_occurrence(spark):
    docs = spark.createDataFrame([(i, "same") for i in (9, 4, 7)], "doc_id long, text string")
    got = ld.repeated_lines(docs, min_documents=3).collect()
    assert [(bytes(r.key), r.n_documents, r.first_row) for r in got] == [(b"same", 3, 4)]


def test_first_occurrence_can_stay(spark):
    rng = random.Random(8)
    rows = [(i % 45, "\n".join(rng.choice((f"Line {rng.randrange(12)} ", f"own {i} {j}")) for j in range(rng.randrange(7)))) for i in range(60)] + [(None, "line 3\nline 4")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    keys = [{k for k in map(ld.line_key, ld.lines_of(t)) if k} for _, t in rows]
    count = Counter(k for ks in keys for k in ks)
    first = {k: min(i for (i, _), ks in zip(rows, keys, strict=True) if k in ks and i is not None) for k, n in count.items() if n >= 5}
    want = []
    for i, t in rows:
        seen, kept = set(), []
        for x in ld.lines_of(t):
            k = ld.line_key(x)
            if k not in first or (i == first[k] and k not in seen):
                kept.append(x)
                seen.add(k)
        want.append((i, len(ld.lines_of(t)), len(ld.lines_of(t)) - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest()))
    for size in (1 << 20, 0):
        assert rows_of(ld.digest(ld.drop_repeated_lines(docs, min_documents=5, broadcast_bytes=size, keep_first=True))) == sorted(want, key=repr)


def test_odd_rows(spark, odd_docs, no_docs):
    for size in (1 << 20, 0):
        got = ld.drop_repeated_lines(odd_docs, min_documents=2, broadcast_bytes=size)
        assert got.count() == odd_docs.count()
        assert sorted(got.columns) == sorted(odd_docs.columns + ["n_dropped"])
        by = {r.doc_id: r for r in got.collect() if r.doc_id}
        assert (by[1].n_lines, by[1].kept if hasattr(by[1], "kept") else by[1].text) == (1, "")
        assert by[5].text == "" and by[9].n_lines == 51
        assert ld.drop_repeated_lines(no_docs, broadcast_bytes=size).count() == 0
