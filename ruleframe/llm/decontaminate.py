"""Benchmark decontamination by pigeonhole edit matching over words.

Plan
----
1. Texts and items become words: A-Z lower-cased, ASCII other than letters and
   digits separates.  An item of m words may differ in k = floor(m *
   ``ERROR_RATE``) words (inserted, removed or replaced).
2. Each item is cut into k + 1 pieces of nearly equal length: whatever the k
   errors are, one piece is left as it was.
3. One pass over the texts hashes all word runs of the pieces' lengths and
   looks them up among the pieces (whole texts; nothing is shuffled).
4. Each hit gives a window of the text around the place where the item must
   lie.  Myers' bit-parallel algorithm computes the least edit distance of the
   item to any run of words in the window; windows of one item that overlap
   are joined first.

The items are taken in blocks of at most ``BLOCK_WORDS`` words, so what goes to
the executors has a fixed bound; each block is one more pass.  With several
blocks the rows get numbers in a stored table, and what the passes find is put
together by that number, so rows stay apart whatever their ids.

Words of scripts that put no spaces between them (Han, kana, Thai, Lao, Burmese,
Khmer) are their characters, so their items have as many words as characters.

Defined results: null and empty texts match nothing, and neither do items
without words.  Items of fewer than five words have no error budget and must be
found word by word.  Equal items and items of equal id are reported alike.
Rows with a null id and repeated rows are matched like others.  Only id and
text are read, so other columns, whatever their names, play no part; without
rows or without items nothing matches.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ruleframe.llm.common import mapped, mix64, stored

ERROR_RATE = 0.2
BLOCK_WORDS = 1_000_000
PART_ROWS = 200

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
# Unicode ranges of scripts without spaces between words.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def words_of(text: str | None) -> list[bytes]:
    text = text or ""
    if not text.isascii() and _UNSPACED.search(text):
        text = _UNSPACED.sub(r" \g<0> ", text)
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def run_hashes(h: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """Hashes of all runs of 1, 2, ... words; entry i starts at word i."""
    out = mix64(h)
    yield 1, out
    for n in range(2, longest + 1):
        if n > len(h):
            return
        out = mix64(out[:-1] + h[n - 1 :] * np.uint64(0x9E3779B97F4A7C15))
        yield n, out


def pieces(m: int, budget: int) -> list[tuple[int, int]]:
    """``budget + 1`` runs that cover m words, as (start, length)."""
    cuts = [m * i // (budget + 1) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: list[int] | np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to a run of ``text``, and its end.

    Bit-vectors of Python integers: any pattern length.  The first of equally
    good ends is returned; the empty run counts with end 0.
    """
    m = len(pattern)
    if m == 0:
        return 0, 0
    peq: dict[int, int] = defaultdict(int)
    for i, symbol in enumerate(pattern):
        peq[int(symbol)] |= 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = mask, 0, m
    best, end = m, 0
    for j, symbol in enumerate(text):
        eq = peq.get(int(symbol), 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & mask)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & mask
        mh = (mh << 1) & mask
        pv = mh | (~(xv | ph) & mask)
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    """Pieces of a block of items, ready for lookups."""

    def __init__(self, items: list[tuple[int, list[bytes]]], rate: float):
        self.items = [(i, word_hashes(w), int(len(w) * rate + 1e-9)) for i, w in items]
        by_length: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for number, (_, h, budget) in enumerate(self.items):
            for start, length in pieces(len(h), budget):
                *_, (_, run) = run_hashes(h[start : start + length], length)
                by_length[length][int(run[0])].append((number, start))
        self.keys = {n: np.array(sorted(k), dtype=np.uint64) for n, k in by_length.items()}
        self.places = {n: [k[key] for key in sorted(k)] for n, k in by_length.items()}

    def matches(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text number, item id, distance, first word, end word) of each match."""
        words = [words_of(t) for t in texts]
        ends = np.cumsum([len(w) for w in words])
        all_words = word_hashes([x for w in words for x in w])
        windows: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for n, run in run_hashes(all_words, max(self.keys, default=0)):
            keys = self.keys.get(n)
            if keys is None:
                continue
            at = np.minimum(np.searchsorted(keys, run), len(keys) - 1)
            hits = np.flatnonzero(keys[at] == run)
            owners = np.searchsorted(ends, hits, side="right")
            for p, key, doc in zip(hits.tolist(), at[hits].tolist(), owners.tolist(), strict=True):
                if p + n > ends[doc]:
                    continue
                first = int(ends[doc]) - len(words[doc])
                for number, start in self.places[n][key]:
                    _, h, budget = self.items[number]
                    lo = max(first, p - start - budget)
                    windows[doc, number].append((lo, min(int(ends[doc]), p - start + len(h) + budget)))
        for (doc, number), spans in sorted(windows.items()):
            item, h, budget = self.items[number]
            first = int(ends[doc]) - len(words[doc])
            best = None
            for lo, hi in joined(spans):
                distance, end = myers(h, all_words[lo:hi])
                if distance <= budget and (best is None or distance < best[0]):
                    _, back = myers(h[::-1], all_words[lo : lo + end][::-1])
                    best = (distance, lo + end - back - first, lo + end - first)
            if best:
                yield doc, item, *best


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def _blocks(benchmark: DataFrame, item_id: str, text: str, most: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    block: list[tuple[int, list[bytes]]] = []
    size = 0
    for row in benchmark.select(item_id, text).where(F.col(text).isNotNull()).distinct().orderBy(item_id, text).toLocalIterator():
        words = words_of(row[1])
        if not words:
            continue
        if block and size + len(words) > most:
            yield block
            block, size = [], 0
        block.append((row[0], words))
        size += len(words)
    if block:
        yield block


def contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", row_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", error_rate: float = ERROR_RATE, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """One row per row of ``docs``: ``<row_id>, matches``.

    ``matches`` is an array of (item_id, distance, first_word, end_word), in
    that order.
    """
    spark = docs.sparkSession
    item_type = benchmark.schema[item_id].dataType
    kinds = {"item_id": item_type.simpleString(), "distance": "bigint", "first_word": "bigint", "end_word": "bigint"}
    matches = f"array<struct<{','.join(f'{n}:{k}' for n, k in kinds.items())}>>"
    arrow = pa.list_(pa.struct([("item_id", to_arrow_type(item_type)), *((n, pa.int64()) for n in list(kinds)[1:])]))

    def matched(rows: DataFrame, block: list[tuple[int, list[bytes]]], every: bool) -> DataFrame:
        """Matches of the rows (key, text) with the items of a block; of ``every`` row or of those with any."""
        shared = spark.sparkContext.broadcast(block)
        key = rows.columns[0]

        def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, error_rate)
            for batch in source:
                for s in range(0, batch.num_rows, PART_ROWS):
                    part = batch.slice(s, PART_ROWS)
                    found: list[list[dict]] = [[] for _ in range(part.num_rows)]
                    for doc, *match in matcher.matches(part.column(1).to_pylist()):
                        found[doc].append(dict(zip(kinds, match, strict=True)))
                    out = pa.RecordBatch.from_arrays([part.column(0), pa.array(found, arrow)], names=[key, "matches"])
                    yield out if every else out.filter(pa.array([bool(f) for f in found]))

        return rows.transform(mapped, run, f"`{key}` {rows.schema[0].dataType.simpleString()}, matches {matches}")

    rows = docs.select(row_id, text)
    blocks = _blocks(benchmark, item_id, item_text, block_words)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return rows.select(row_id, F.expr(f"cast(array() as {matches})").alias("matches"))
    if second is None:
        return matched(rows, first, every=True).select(row_id, F.array_sort("matches").alias("matches"))
    numbered = stored(rows.select(F.monotonically_increasing_id().alias("__row"), F.col(row_id).alias("__id"), F.col(text).alias("__text")), "numbered-rows")
    parts = [stored(matched(numbered.select("__row", "__text"), b, every=False), "block-matches") for b in (first, second, *blocks)]
    found = reduce(DataFrame.unionAll, parts).groupBy("__row").agg(F.array_sort(F.flatten(F.collect_list("matches"))).alias("matches"))
    joined = numbered.select("__row", "__id").join(found, "__row", "left")
    return joined.select(F.col("__id").alias(row_id), F.coalesce("matches", F.expr(f"cast(array() as {matches})")).alias("matches"))


def report(docs: DataFrame, benchmark: DataFrame, row_id: str = "doc_id", **options) -> DataFrame:
    """``<row_id>, contaminated, n_items, items, min_distance`` per row."""
    found = contamination(docs, benchmark, row_id=row_id, **options)
    items = F.array_sort(F.array_distinct("matches.item_id"))
    return found.select(
        row_id,
        (F.size("matches") > 0).alias("contaminated"),
        F.size(items).cast("long").alias("n_items"),
        items.alias("items"),
        F.array_min("matches.distance").alias("min_distance"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, row_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the rows that hold an item; columns stay as they are.

    Rows with a null id stay.  Rows that share an id go if one of them does.
    """
    gone = contamination(docs, benchmark, row_id=row_id, **options).where(F.size("matches") > 0).select(row_id).distinct()
    return docs.join(gone, row_id, "left_anti")
