import random
import time
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ruleframe.llm import toxicity as tx


def made(n=600, seed=1):
    rng = random.Random(seed)
    stems, bad = ["ban", "tel", "mor", "sil", "ked", "rup"], ["vraxo", "gluntish"]
    rows = []
    for i in range(n):
        words = ["".join(rng.choice(stems) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(20, 120))]
        label = int(rng.random() < 0.15)
        if label:
            for _ in range(max(2, len(words) // 15)):
                words[rng.randrange(len(words))] = rng.choice(bad) + rng.choice(stems)
        rows.append((i, " ".join(words), label))
    return rows


def test_held_out_accuracy(spark):
    rows = made()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in tx.toxicity_scores(docs, labels).collect()}
    assert len(got) == len(rows)
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert all(got[r[0]].held_out == (r in held) for r in rows)
    assert np.mean([got[r[0]].predicted == r[2] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    # Labels of held-out rows are never read.
    flipped = labels.withColumn("toxic", F.when(tx.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in tx.toxicity_scores(docs, flipped).collect()}
    assert all(abs(again[i] - got[i].score) < 1e-9 for i in again)
    kept = tx.keep_ordinary(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in got.values())


def test_grams_stay_within_words():
    number, place, hashes = tx.grams([b"ab", b"abc"])
    assert place.tolist() == [0, 1, 2, 0, 1, 2, 3] and number.tolist() == [0, 0, 0, 1, 1, 1, 1]
    assert hashes[2][2] == hashes[2][5] and hashes[0][1] != hashes[0][2]


def test_filter_keeps_every_partner(spark):
    source = spark.range(5000).withColumnRenamed("id", "id")
    ids = spark.range(0, 5000, 50)
    got = {r.id for r in tx.likely(source, ids).collect()}
    assert got >= set(range(0, 5000, 50)) and len(got) < 1000
    assert tx.likely(source, ids.where("false")).count() == 0


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, None), (None, 1), (6, 0), (8, 1)], "doc_id long, toxic int")
    got = tx.toxicity_scores(odd_docs, labels)
    assert got.count() == odd_docs.count()
    nothing = tx.toxicity_scores(odd_docs, labels.where("false")).collect()
    assert {r.score for r in nothing} == {0.0} and {r.predicted for r in nothing} == {0}
    assert tx.toxicity_scores(no_docs, labels).count() == 0
    assert tx.keep_ordinary(odd_docs, labels).where("doc_id is null").count() == 2


def direct_ratio(parts, backs, word):
    """Interpolated log ratio of one word, byte by byte, from the collected tables."""
    _, place, hashes = tx.grams([word])
    total = 0.0
    for at in range(1, len(place)):
        p = list(parts.get((1, int(tx.signed(hashes[0][at : at + 1])[0])), (1e-4, 1e-4)))
        for k in range(2, min(tx.ORDER, at + 1) + 1):
            gram, context = (int(tx.signed(h)[0]) for h in (hashes[k - 1][at : at + 1], hashes[k - 2][at - 1 : at]))
            part, back = parts.get((k, gram), (0, 0)), backs.get((k, context), (1, 1))
            p = [part[c] + back[c] * p[c] for c in (0, 1)]
        total += np.log(max(p[0], 1e-12)) - np.log(max(p[1], 1e-12))
    return total


def test_every_gram_counts_however_few_are_shared(spark):
    rows = made(120, seed=4)
    labelled = spark.createDataFrame(rows, "id long, text string, toxic int")
    model = tx.fit_model(labelled)
    parts = {(r.k, r.gram): (r.part_tox, r.part_ord) for r in model[0].collect()}
    backs = {(r.k, r.context): (r.back_tox, r.back_ord) for r in model[1].collect()}
    distinct = {(k, int(h)) for w in {w for r in rows for w in tx.words_of(r[1])} for _, place, hs in [tx.grams([w])] for k in range(1, tx.ORDER + 1) for h in tx.signed(hs[k - 1])[(place >= 1) & (place >= k - 1)]}
    assert parts.keys() == distinct
    texts = [*((r[0], r[1]) for r in rows), (120, "never seen zzyx"), (121, None), (122, ""), (120, "never seen zzyx")]
    source = spark.createDataFrame([(t, i) for i, t in texts], "text string, id long")
    want = sorted((i, *tx.features(np.array([direct_ratio(parts, backs, w) for w in tx.words_of(t)]))) for i, t in texts)
    for bound in (tx.SHARED_ENDINGS, 40, 0):
        got = sorted(tuple(r) for r in tx.text_features(source, model, bound).collect())
        assert np.allclose(got, want, atol=1e-9), bound


def test_a_text_costs_no_pass_over_the_shared_endings():
    """at 6 GB most texts with a rare word went through all the shared endings."""
    known = [w for r in made(40, seed=3) for w in tx.words_of(r[1])]
    own = np.unique(tx.endings(known)[1])
    texts = [f"ban telmor zq{i}x sil qq{i}" for i in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(40)), pa.array(texts)], names=["text", "id", "text_key"])

    def lacking(size):
        keys = np.unique(np.concatenate([own, np.arange(max(0, size - len(own))) + (1 << 50)]))
        began = time.process_time()
        got = next(tx._featured(SimpleNamespace(value=(keys, np.zeros(len(keys)))))(iter([batch]))).column("lacking").to_pylist()
        took = time.process_time() - began
        assert got == [np.setdiff1d(tx.endings(tx.words_of(t))[1], own).tolist() for t in texts]
        return took

    lacking(0)
    assert lacking(tx.SHARED_ENDINGS) < 10 * lacking(0) + 0.5


class PlainModel:
    """Interpolated Kneser-Ney over byte strings, written down from the definition."""

    def __init__(self, rows):
        counts = [Counter(w for _, t, y in rows if y == c for w in set(tx.words_of(t))) for c in (0, 1)]
        self.raw = [[Counter() for _ in range(tx.ORDER + 2)] for _ in (0, 1)]
        for c in (0, 1):
            for w, n in counts[c].items():
                marked = b"\x01" + w
                for at in range(1, len(marked)):
                    for k in range(1, min(tx.ORDER, at + 1) + 1):
                        self.raw[c][k][marked[at - k + 1 : at + 1]] += n

    def value(self, c, g):
        if len(g) == tx.ORDER or g[:1] == b"\x01":
            return self.raw[c][len(g)][g]
        return sum(1 for longer in self.raw[c][len(g) + 1] if longer[1:] == g)

    def chance(self, c, g):
        if len(g) == 1:
            bytes_seen = {b for d in (0, 1) for b in self.raw[d][1]}
            n = {b: self.value(0, b) + self.value(1, b) + 0.5 for b in bytes_seen}
            return n[g] / (sum(n.values()) + 128) if g in n else 1e-4
        here = {x: self.value(c, x) for x in self.raw[c][len(g)] if x[:-1] == g[:-1]}
        total, shorter = sum(here.values()), self.chance(c, g[1:])
        if not total:
            return shorter
        held = sum(max(v - tx.DISCOUNT, 0) for v in here.values())
        return max(here.get(g, 0) - tx.DISCOUNT, 0) / total + (1 - held / total) * shorter

    def ratio(self, word):
        marked = b"\x01" + word
        ends = [marked[max(0, at - tx.ORDER + 1) : at + 1] for at in range(1, len(marked))]
        return sum(np.log(self.chance(1, g)) - np.log(self.chance(0, g)) for g in ends)


def test_probabilities_equal_the_definition(spark):
    rows = [(i, t, y) for i, (_, t, y) in enumerate(made(40, seed=6))]
    plain = PlainModel(rows)
    model = tx.fit_model(spark.createDataFrame(rows, "id long, text string, toxic int"))
    words = sorted({w for r in rows for w in tx.words_of(r[1])})[::3] + [b"vraxo", b"zq9", b"ban", b"b"]
    source = spark.createDataFrame([(w.decode(), i) for i, w in enumerate(words)], "text string, id long")
    got = {r.id: r["mean"] for r in tx.text_features(source, model).collect()}
    for i, w in enumerate(words):
        assert abs(got[i] - plain.ratio(w)) < 1e-8, w


def test_long_words_count_whole(spark):
    rng = random.Random(5)
    word = "".join(rng.choice("abcdefgh") for _ in range(333))
    pieces = tx.pieces_of(word)
    assert len(pieces) == 6 and tx.pieces_of("ab cd") == [b"ab", b"cd"] and tx.pieces_of("a" * 64) == [b"a" * 64]
    # The pieces have just the endings that the uncut word has.
    assert sorted(tx.endings(pieces)[1].tolist()) == sorted(tx.endings([word.encode()])[1].tolist())
    # An expression late in an unspaced text is learnt and found.
    glued = lambda n: "".join(rng.choice("日本語文字今天我們") for _ in range(n))
    rows = [(i, glued(60) + ("毒毒悪" if i % 2 else glued(3)) + glued(10), i % 2) for i in range(80)]
    model = tx.fit_model(spark.createDataFrame(rows, "id long, text string, toxic int"))
    same = glued(50)
    source = spark.createDataFrame([(same + "毒毒悪", 1), (same + "日本語", 2)], "text string, id long")
    got = {r.id: r.mean for r in tx.text_features(source, model).collect()}
    assert got[1] > got[2] + 1
