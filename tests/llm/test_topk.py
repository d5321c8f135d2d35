import math
import random

import numpy as np
from pyspark.sql import functions as F

from ruleframe.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, score string, q int"


def brute(rows, k):
    ints = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in ints:
        if i % 100 == 0:
            near = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, v, strict=True)))), j) for j, v in ints if j != i and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(near[:k])]
    return sorted(out)


def run(spark, rows, k=5, **options):
    df = spark.createDataFrame([(i, v, 0, "s", 1) for i, v in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in topk.top_k(df, df.where(F.col("vec_id") % 100 == 0), k=k, **options).collect())


def test_matches_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(12)]) for i in range(900)]
    rows += [(1000 + i, [0.5] * 12) for i in range(300)]
    want = brute(rows, 5)
    assert run(spark, rows) == want
    assert run(spark, rows, wave_bytes=3 * 96) == want


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (100, [1.0, 2.0]), (200, None), (300, [nan, 1.0]), (400, [inf, 1.0]), (500, []), (600, [None, 1.0]), (700, [1.0, 2.0, 3.0]), (1, [0.0, 0.0]), (2, [-1.0, 3e18])]
    assert run(spark, rows) == brute(rows, 5)
    assert run(spark, [(1, [1.0])]) == []
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []


def test_equal_vectors_and_repeated_ids(spark):
    rng = random.Random(3)
    rows = [(i, [0.25, -0.5, 0.125]) for i in range(0, 700)]
    rows += [(i, [rng.choice((-0.5, 0.5)) for _ in range(3)]) for i in range(700, 1000)]
    rows += [(100, [0.5, 0.5, 0.5]), (100, [0.25, -0.5, 0.125]), (703, [0.5, 0.5, 0.5]), (703, [-0.5, 0.5, 0.5])]
    got = run(spark, rows, wave_bytes=100)
    want = brute([r for i, r in enumerate(rows) if r not in rows[:i] or r[0] % 100], 5)
    assert got == want


def test_bounds_hold():
    rng = np.random.default_rng(0)
    v, q = np.floor(rng.normal(0, 300, (200, 8))), np.floor(rng.normal(0, 300, (20, 8)))
    low = v.min(axis=0)
    step = (v.max(axis=0) - low) / topk.CELLS
    codes = np.minimum(np.floor((v - low) / step), topk.CELLS - 1).astype(np.uint8)
    down, up = topk.bounds(q, codes, low, step)
    exact = q @ v.T
    assert (down <= exact).all() and (exact <= up).all() and (up - down).max() < 1e6
