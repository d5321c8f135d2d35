import random
import zlib

from ruleframe.llm import sharding as sh


def check(rows, n, shards, slack):
    assert len(rows) == n
    size = [0] * shards
    slots = {}
    for r in rows:
        size[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    mean = sum(size) / shards
    assert all(abs(b - mean) <= slack for b in size), size


def test_equal_bytes_with_a_hot_text(spark):
    rng = random.Random(1)
    rows = [(i, "hot " * 20 if i % 3 == 0 else "t" * rng.randrange(200)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sh.digest(sh.shard_rows(docs)).collect()
    check(got, 3000, 16, 450)
    text = dict(rows)
    assert all(r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.size == len(text[r.doc_id]) + 1 for r in got)
    # Shards follow the keys, so equal texts fill neighbouring shards.
    hot = sorted({r.shard for r in got if r.doc_id % 3 == 0})
    assert hot == list(range(hot[0], hot[-1] + 1))


def test_counts_below_probes(spark):
    sized = spark.createDataFrame([(k, k + 1) for k in range(100)], "key long, size long")
    rows, size = sh.histogram(sized, [0, 10, 50])
    assert rows == [0, 10, 50, 100] and size == [0, 55, 1275, 5050]


def test_real_output_keeps_columns(spark, odd_docs, no_docs):
    got = sh.shard_rows(odd_docs, shards=4)
    assert sorted(got.columns) == sorted(odd_docs.columns + ["shard"])
    assert sh.digest(got).count() == odd_docs.count()
    assert sorted((r.doc_id, r.text) for r in got.collect() if r.doc_id and r.text) == sorted((r.doc_id, r.text) for r in odd_docs.collect() if r.doc_id and r.text)
    check(sh.digest(got).collect(), odd_docs.count(), 4, 10**6)
    assert sh.shard_rows(no_docs).count() == 0


def test_boundaries_are_refined_to_the_last_bit(spark):
    # All bytes lie in a range of keys that twelve 17-fold rounds leave in one bracket.
    sized = spark.range(20_000).selectExpr("id AS key", "1L AS size")
    edges = sh.splitters(sized, 20_000, 4, 1, sh.TOLERANCE)
    assert all(abs(e - 5000 * i) <= 5000 * sh.TOLERANCE for i, e in enumerate(edges, 1)), edges
