"""Toxicity by class-conditional Kneser-Ney models.

Plan
----
1. Rows with a label are split by crc32 of the id: remainder 0 of 5 is held
   out and never seen; remainder 4 calibrates; the others give the counts.
2. Words of those rows are counted by class (number of rows that hold them)
   over *all* rows: tasks count their batches first, then one aggregation.
   N-grams of bytes within words, orders 1 to ``ORDER``, follow from the words.
3. Each class gets an interpolated Kneser-Ney model of its words, byte by byte:
   raw counts at the highest order and at the start of a word, continuation
   counts (distinct left neighbours) below, and under them a distribution that
   both classes share.  All counts of both classes are used as they are.  A rare
   or unknown expression thus gets its probability from parts of words.
4. A text is scored by the difference of the two log-likelihoods: the mean over
   all its words and the largest means over windows of words, normalised by
   length.  A logistic fit on the calibration rows (at most
   ``CALIBRATION_ROWS``, those with a small hash of the id) maps them to a
   probability.

All n-grams stay in stored tables.  The endings of the corpus (the last bytes,
``ORDER`` at most, at each place of a word) are gathered over all rows, and
joins with those tables, order by order, give each ending the log ratio of its
last byte.  Tasks that score get the ``SHARED_ENDINGS`` most frequent endings
(16 MB); rows with others look those up by a further join.  So the bound of the
broadcast changes no score.

Defined results: a word of more than ``WORD_BYTES`` bytes (a glued token, a
sentence of an unspaced script) is learnt and scored as successive pieces, each
of which counts as a word; none of its bytes is left out.  A null text counts as empty; an empty text has the features
of no evidence.  A null id counts as the empty text for the split.  Of several
labels of one id the largest counts.  Without training rows of both classes
every score is the share of toxic rows (0 without rows).  Repeated rows are scored
each for itself.  Only the named columns of texts and labels are read, so others,
whatever their names, play no part; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from math import isnan

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ruleframe.llm.common import likely, mapped, mix64, signed, stored

FOLDS = 5
CALIBRATION_FOLD = 4
CALIBRATION_ROWS = 50_000
ORDER = 6
SHARED_ENDINGS = 1 << 20
WINDOWS = (8, 40)
DISCOUNT = 0.75
CACHED_WORDS = 500_000
LISTED_WORDS = 100_000
ROUND_WORDS = 20_000
ROUND_ROWS = 500
WORD_BYTES = 64
LATER = b"\x02"

_FOLD_CASE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words; ASCII other than letters and digits splits them."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD_CASE).split()


def pieces_of(text: str | None) -> list[bytes]:
    """Words, long ones as pieces of ``WORD_BYTES`` bytes.

    A later piece begins with ``LATER`` and the ``ORDER`` - 1 bytes before it,
    which are context only, so each byte of a word counts once.
    """
    words = words_of(text)
    if not any(len(w) > WORD_BYTES for w in words):
        return words
    out = []
    for w in words:
        out.append(w[:WORD_BYTES])
        out += [LATER + w[s - ORDER + 1 : s + WORD_BYTES] for s in range(WORD_BYTES, len(w), WORD_BYTES)]
    return out


def _marked(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the words with a mark before each, the word's number, the place in it."""
    raw = np.frombuffer(b"".join(w if w[:1] == LATER else b"\x01" + w for w in words), dtype=np.uint8)
    start = raw <= LATER[0]
    number = np.cumsum(start) - 1
    return raw, number, np.arange(len(raw)) - np.flatnonzero(start)[number]


def _counts(raw: np.ndarray, number: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Places that are neither a mark nor the context of a later piece."""
    later = raw[place == 0] == LATER[0]
    return place >= np.where(later, ORDER, 1)[number]


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Hashes of the byte n-grams that end at each place of each word.

    Returns the word's number and the place in it (from 1; the start mark
    before a word has place 0), and for each order k an array of hashes.  The
    entry of order k holds k bytes and is valid where k - 1 <= place.
    """
    raw, number, place = _marked(words)
    hashes = [mix64(raw.astype(np.uint64) + np.uint64(257))]
    for k in range(2, ORDER + 1):
        back = np.zeros(len(raw), dtype=np.uint64)
        back[k - 1 :] = raw[: max(0, len(raw) - k + 1)]
        hashes.append(mix64(hashes[-1] + (back + np.uint64(3)) * np.uint64(0x9E3779B97F4A7C15)))
    return number, place, hashes


def fold(row_id: Column) -> Column:
    return F.crc32(F.coalesce(row_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def _count_words(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each class that hold a word, summed over the batch."""
    for batch in source:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            seen[1 if label else 0].update(set(pieces_of(text.as_py())))
        words = list(seen[0].keys() | seen[1].keys())
        if words:
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array([seen[1][w] for w in words], pa.int64()), pa.array([seen[0][w] for w in words], pa.int64())], names=["word", "tox", "ord"]
            )


GRAMS = "k int, gram bigint, context bigint, suffix bigint, start boolean, tox double, ord double"


def _count_grams(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        words = batch.column(0).to_pylist()
        counts = [batch.column(i).to_numpy().astype(float) for i in (1, 2)]
        number, place, hashes = grams(words)
        counted = _counts(*_marked(words))
        for k in range(1, ORDER + 1):
            at = np.flatnonzero(counted & (place >= k - 1))
            if not len(at):
                continue
            gram, index, inverse = np.unique(hashes[k - 1][at], return_index=True, return_inverse=True)
            one = at[index]
            none = np.zeros(len(one), dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(one), k, dtype=np.int32)),
                    pa.array(signed(gram)),
                    pa.array(signed(hashes[k - 2][one - 1] if k > 1 else none)),
                    pa.array(signed(hashes[k - 2][one] if k > 1 else none)),
                    pa.array(place[one] == k - 1),
                    *(pa.array(np.bincount(inverse, weights=c[number[at]], minlength=len(one))) for c in counts),
                ],
                names=["k", "gram", "context", "suffix", "start", "tox", "ord"],
            )


def fit_model(labelled: DataFrame, text: str = "text", label: str = "toxic") -> tuple[DataFrame, DataFrame] | None:
    """Both classes' models over all rows of ``labelled``.

    One row per n-gram (the share of its context that it keeps) and one per
    context (the share that is left to the backoff); order 1 has the shared
    distribution and no contexts.
    """
    words = labelled.select(text, label).transform(mapped, _count_words, "word binary, tox bigint, ord bigint")
    words = stored(words.groupBy("word").agg(F.sum("tox").alias("tox"), F.sum("ord").alias("ord")), "word-counts")
    n = words.agg(F.sum("tox").alias("tox"), F.sum("ord").alias("ord")).first()
    if not n.tox or not n.ord:
        return None
    both = ("tox", "ord")
    each = words.transform(mapped, _count_grams, GRAMS).groupBy("k", "gram", "context", "suffix", "start")
    table = stored(each.agg(*(F.sum(c).alias(c) for c in both)), "gram-counts")
    # Continuation counts: how many longer grams end in this one.
    left = table.where("k > 1").groupBy((F.col("k") - 1).alias("k"), F.col("suffix").alias("gram")).agg(*(F.sum((F.col(c) > 0).cast("double")).alias(f"n_{c}") for c in both))
    counted = table.join(left, ["k", "gram"], "left").select(
        "k", "gram", "context",
        *(F.when((F.col("k") == ORDER) | F.col("start"), F.col(c)).otherwise(F.coalesce(f"n_{c}", F.lit(0.0))).alias(c) for c in both),
    )
    counted = stored(counted, "continuation-counts")
    kept = {c: F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) for c in both}
    totals = counted.where("k > 1").groupBy("k", "context").agg(*(F.sum(c).alias(f"all_{c}") for c in both), *(F.sum(kept[c]).alias(f"held_{c}") for c in both))
    totals = stored(totals, "context-totals")
    share = {c: F.when(F.col(f"all_{c}") > 0, kept[c] / F.col(f"all_{c}")).otherwise(0.0) for c in both}
    parts = counted.where("k > 1").join(totals, ["k", "context"]).select("k", "gram", *(share[c].alias(f"part_{c}") for c in both))
    low = counted.where("k = 1").withColumn("n", F.col("tox") + F.col("ord") + 0.5)
    shared = low.crossJoin(F.broadcast(low.agg(F.sum("n").alias("total")))).withColumn("p", F.col("n") / (F.col("total") + 128))
    parts = parts.unionByName(shared.select("k", "gram", *(F.col("p").alias(f"part_{c}") for c in both)))
    left_over = {c: F.when(F.col(f"all_{c}") > 0, 1 - F.col(f"held_{c}") / F.col(f"all_{c}")).otherwise(1.0) for c in both}
    return stored(parts, "gram-parts"), totals.select("k", "context", *(left_over[c].alias(f"back_{c}") for c in both))


def endings(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the word and ending, as one whole number, of each byte of the words."""
    raw, number, place = _marked(words)
    packed = raw.astype(np.int64)
    for i in range(1, ORDER):
        packed[i:] += np.where(place[i:] >= i, raw[: max(0, len(raw) - i)].astype(np.int64) << (8 * i), 0)
    at = np.flatnonzero(_counts(raw, number, place))
    return number[at], packed[at]


def _list_endings(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Endings of the words, with the number of words that have them."""
    seen: set[bytes] = set()
    new: set[bytes] = set()

    def counted() -> pa.RecordBatch:
        found, times = np.unique(endings(list(new))[1], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array(times)], names=["ending", "n"])

    for batch in source:
        for text in batch.column(0):
            new.update(pieces_of(text.as_py()))
            if len(new) > ROUND_WORDS:
                new -= seen
                if len(new) < ROUND_WORDS // 2:
                    continue
                yield counted()
                if len(seen) > LISTED_WORDS:
                    seen.clear()
                seen |= new
                new = set()
    new -= seen
    if new:
        yield counted()


WANTED = "k int, gram bigint, context bigint, suffix bigint, ending bigint"


def _wanted_grams(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-grams that end an ending; ``ending`` is null but for the whole of it."""
    for batch in source:
        packed = batch.column(0).to_numpy()
        byte = [(packed >> (8 * i)) & 255 for i in range(ORDER)]
        size = np.sum([packed >> (8 * i) > 0 for i in range(ORDER)], axis=0)
        own, before = _chain(byte), [np.zeros(len(packed), dtype=np.uint64), *_chain(byte[1:])]
        for k in range(1, ORDER + 1):
            at = np.flatnonzero(size >= k)
            _, index = np.unique(own[k - 1][at], return_index=True)
            at = at[index]
            suffix = own[k - 2][at] if k > 1 else np.zeros(len(at), dtype=np.uint64)
            columns = [pa.array(np.full(len(at), k, dtype=np.int32)), *(pa.array(signed(h)) for h in (own[k - 1][at], before[k - 1][at], suffix))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(packed[at], mask=size[at] != k)], names=["k", "gram", "context", "suffix", "ending"])


def _chain(byte: list[np.ndarray]) -> list[np.ndarray]:
    """Hashes as of ``grams``, given the last byte, the one before it and so on."""
    hashes = [mix64(byte[0].astype(np.uint64) + np.uint64(257))]
    for b in byte[1:]:
        hashes.append(mix64(hashes[-1] + (b.astype(np.uint64) + np.uint64(3)) * np.uint64(0x9E3779B97F4A7C15)))
    return hashes


def ending_ratios(model: tuple[DataFrame, DataFrame], listed: DataFrame) -> DataFrame:
    """``ending, ratio``: log P(last byte | toxic) - log P(last byte | ordinary)."""
    parts, backs = model
    wanted = listed.select("ending").transform(mapped, _wanted_grams, WANTED).groupBy("k", "gram").agg(*(F.max(c).alias(c) for c in ("context", "suffix", "ending")))
    both = ("tox", "ord")
    known = stored(wanted.join(parts, ["k", "gram"], "left").join(backs, ["k", "context"], "left"), "wanted-grams")
    below = known.where("k = 1").select("k", "gram", "ending", *(F.coalesce(f"part_{c}", F.lit(1e-4)).alias(c) for c in both))
    found = []
    for k in range(2, ORDER + 1):
        shorter = below.select(F.col("gram").alias("suffix"), *both)
        p = {c: F.coalesce(f"part_{c}", F.lit(0.0)) + F.coalesce(f"back_{c}", F.lit(1.0)) * F.col(c) for c in both}
        below = stored(known.where(F.col("k") == k).join(shorter, "suffix").select("k", "gram", "ending", *(p[c].alias(c) for c in both)), "gram-chances")
        found.append(below.where("ending IS NOT NULL"))
    log = {c: F.log(F.greatest(F.col(c), F.lit(1e-12))) for c in both}
    return reduce(DataFrame.unionByName, found).select("ending", (log["tox"] - log["ord"]).alias("ratio"))


def known_ratios(keys: np.ndarray, ratios: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Ratio of each ending, by a search in the sorted ``keys``; NaN where they lack it."""
    if not len(keys):
        return np.full(len(packed), np.nan)
    at = np.minimum(np.searchsorted(keys, packed), len(keys) - 1)
    return np.where(keys[at] == packed, ratios[at], np.nan)


def word_ratios(keys: np.ndarray, ratios: np.ndarray, words: list[bytes]) -> np.ndarray:
    """log P(word | toxic) - log P(word | ordinary); NaN where ``keys`` lack an ending."""
    number, packed = endings(words)
    return np.bincount(number, weights=known_ratios(keys, ratios, packed), minlength=len(words))


def features(ratios: np.ndarray) -> list[float]:
    """Mean log ratio of the text, then the largest mean of each window size."""
    if not len(ratios):
        return [0.0] * (1 + len(WINDOWS))
    total = np.concatenate([[0.0], np.cumsum(ratios)])
    out = [float(total[-1] / len(ratios))]
    for w in WINDOWS:
        out.append(float((total[w:] - total[:-w]).max() / w) if len(ratios) > w else float(total[-1] / w))
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Newton's method for a ridge logistic regression with an intercept."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


NAMES = ["mean", *(f"peak{w}" for w in WINDOWS)]


def _slices(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, few at a time: words take many times the memory of the text."""
    for batch in source:
        for s in range(0, batch.num_rows, ROUND_ROWS):
            yield batch.slice(s, ROUND_ROWS)


def _featured(shared):
    """Features of each text, or the endings that they still need."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ratios = shared.value
        cache: dict[bytes, float] = {}
        for batch in _slices(source):
            texts = [pieces_of(t.as_py()) for t in batch.column(0)]
            if len(cache) > CACHED_WORDS:
                cache.clear()
            new = list({w for t in texts for w in t} - cache.keys())
            for s in range(0, len(new), ROUND_WORDS):
                cache.update(zip(new[s : s + ROUND_WORDS], word_ratios(keys, ratios, new[s : s + ROUND_WORDS]).tolist(), strict=True))
            rows = [features(np.array([cache[w] for w in words])) for words in texts]
            lacking = [absent(keys, ratios, [w for w in set(words) if isnan(cache[w])]) if isnan(r[0]) else None for r, words in zip(rows, texts, strict=True)]
            found = [pa.array([r[i] for r in rows], pa.float64()) for i in range(len(NAMES))]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), *found, pa.array(lacking, pa.list_(pa.int64()))], names=["id", "text_key", *NAMES, "lacking"])

    return run


def absent(keys: np.ndarray, ratios: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Endings of the words that ``keys`` lack.

    Runs for each text, so it searches the keys and never goes through all of them.
    """
    packed = endings(words)[1]
    return np.unique(packed[np.isnan(known_ratios(keys, ratios, packed))])


def _featured_alone(shared):
    """Features of texts that bring the endings which the shared ones lack."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ratios = shared.value
        for batch in _slices(source):
            rows = []
            for text, own in zip(batch.column(0), batch.column(2), strict=True):
                words = pieces_of(text.as_py())
                once = list(set(words))
                number, packed = endings(once)
                each = known_ratios(keys, ratios, packed)
                own_keys, own_ratios = (own.values.field(c).to_numpy(zero_copy_only=False) for c in ("ending", "ratio"))
                order = np.argsort(own_keys)
                lack = np.flatnonzero(np.isnan(each))
                each[lack] = own_ratios[order][np.searchsorted(own_keys[order], packed[lack])]
                value = dict(zip(once, np.bincount(number, weights=each, minlength=len(once)).tolist(), strict=True))
                rows.append(features(np.array([value[w] for w in words])))
            found = [pa.array([r[i] for r in rows], pa.float64()) for i in range(len(NAMES))]
            yield pa.RecordBatch.from_arrays([batch.column(1), *found], names=["id", *NAMES])

    return run


def least_count(listed: DataFrame, bound: int) -> int:
    """Least ``n`` that at most ``bound`` rows reach, from a histogram of at most 512 cells."""
    cells = listed.groupBy(F.floor(F.log2("n") * 8).alias("cell")).agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("n")).collect()
    least, rows = 1 << 62, 0
    for c in sorted(cells, key=lambda c: -c.cell):
        rows += c.rows
        if rows > bound:
            break
        least = c.n
    return least


def at_most(rows: DataFrame, bound: int) -> DataFrame:
    """``bound`` rows at most: those whose hash of the id (``h``) is under a share of its range.

    The share leaves a margin of six deviations, so the limit is for odd hashes only.
    """
    total = rows.count()
    if total <= bound:
        return rows
    share = max(0.0, (bound - 6 * bound**0.5) / total)
    return rows.where(F.col("h") < int(-(1 << 63) + share * (1 << 64))).limit(bound)


def text_features(source: DataFrame, model: tuple[DataFrame, DataFrame], shared_endings: int | None = None) -> DataFrame:
    """``id`` and features of every row of ``source`` (columns ``text, id``)."""
    spark = source.sparkSession
    listed = stored(source.select("text").transform(mapped, _list_endings, "ending bigint, n bigint").groupBy("ending").agg(F.sum("n").alias("n")), "endings")
    ratios = ending_ratios(model, listed)
    bound = SHARED_ENDINGS if shared_endings is None else shared_endings
    whole = listed.count() <= bound
    if not whole:
        ratios = stored(ratios.join(listed, "ending"), "ending-ratios")
        most = ratios.where(F.col("n") >= least_count(listed, bound))
    got = (ratios if whole else most).select("ending", "ratio").toArrow()
    order = np.argsort(got.column("ending").to_numpy())
    shared = spark.sparkContext.broadcast((got.column("ending").to_numpy()[order], got.column("ratio").to_numpy()[order]))
    kind = source.schema["id"].dataType.simpleString()
    columns = f"id {kind}" + "".join(f", {n} double" for n in NAMES)
    keyed = source.select("text", "id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_key"))
    found = stored(keyed.transform(mapped, _featured(shared), columns.replace(",", ", text_key string,", 1) + ", lacking array<bigint>"), "toxicity-features")
    if whole:
        return found.select("id", *NAMES)
    asked = found.where("lacking IS NOT NULL").select("text_key", F.explode("lacking").alias("ending")).distinct()
    own = stored(asked.join(ratios.select("ending", "ratio"), "ending").groupBy("text_key").agg(F.collect_list(F.struct("ending", "ratio")).alias("own")), "own-endings")
    rest = likely(keyed, own.select("text_key"), "text_key").join(own, "text_key").select("text", "id", "own").transform(mapped, _featured_alone(shared), columns)
    return stored(found.where("lacking IS NULL").select("id", *NAMES).unionByName(rest), "all-features")


def toxicity_scores(docs: DataFrame, labels: DataFrame, text: str = "text", row_id: str = "doc_id", label: str = "toxic", calibration_rows: int = CALIBRATION_ROWS) -> DataFrame:
    """``<row_id>, held_out, mean, peak8, peak40, score, predicted`` for every row of ``docs``."""
    known = labels.where(F.col(label).isNotNull() & F.col(row_id).isNotNull()).groupBy(F.col(row_id).alias("id")).agg(F.max(label).alias("label"))
    source = docs.select(F.col(text).alias("text"), F.col(row_id).alias("id"))
    training = ~fold(F.col("id")).isin(0, CALIBRATION_FOLD)
    # Only texts that may have a training label are shuffled.
    train = known.where(training)
    model = fit_model(likely(source.where(training), train).join(train, "id"), "text", "label")
    if model is None:
        share = docs.select(F.col(row_id).alias("id")).join(known.where(fold(F.col("id")) != 0), "id").agg(F.avg(F.col("label").cast("double")).alias("p")).first().p
        found = source.select("id", *(F.lit(0.0).alias(n) for n in NAMES))
        score = F.lit(float(share or 0.0))
    else:
        found = text_features(source, model)
        held = found.join(known.where(fold(F.col("id")) == CALIBRATION_FOLD), "id").withColumn("h", F.xxhash64("id"))
        rows = at_most(held, calibration_rows).select("label", *NAMES).toArrow()
        y = rows.column("label").to_numpy().astype(float)
        x = np.column_stack([rows.column(n).to_numpy() for n in NAMES])
        weights = [float(v) for v in logistic(x, y)] if 0 < y.sum() < len(y) else [0.0, *(4.0 for _ in NAMES)]
        z = sum((F.lit(w) * F.col(n) for w, n in zip(weights[1:], NAMES, strict=True)), F.lit(weights[0]))
        score = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    return found.select(F.col("id").alias(row_id), (fold(F.col("id")) == 0).alias("held_out"), *NAMES, score.alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


def keep_ordinary(docs: DataFrame, labels: DataFrame, row_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the rows that the model rejects; columns stay as they are.

    Rows with a null id stay.  Rows that share an id go if one of them does.
    """
    gone = toxicity_scores(docs, labels, row_id=row_id, **options).where("predicted = 1").select(row_id).distinct()
    return docs.join(gone, row_id, "left_anti")


