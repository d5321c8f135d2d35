"""Histogram sort: cut a corpus into shards of near equal bytes.

Plan
----
1. Every row gets a 64-bit key: 40 bits from its text, 24 bits from its id.
   Equal texts lie side by side, and a group of copies that is larger than a
   shard is cut between its ids.  Key and size (16 bytes a row) are stored once.
2. Rounds count, over all partitions, the exact bytes and rows below candidate
   boundaries.  Each boundary has a bracket that the counts narrow, and gets
   new probes inside it, until the shard boundaries meet the tolerance.  Only
   the counts of the probes reach the driver; their number is bounded.
3. The boundaries also cut each shard into buckets, the units of work: no task
   handles a whole shard of a large corpus.
4. One exchange moves the rows to their buckets.  The exact counts below a
   bucket are where its slots start, so slots need no second exchange.

Law ``bytes``: a shard differs from the mean by at most twice the tolerance
plus the largest rows at its two boundaries.

Defined results: a null text counts as no bytes; every row has one byte more
for its end.  Rows that agree in text and id share a key and are not cut apart.
Input columns named ``shard`` or ``slot`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ruleframe.llm.common import mapped, partitions_for, stored

LOW, HIGH = -(1 << 63), (1 << 63) - 1
PROBES = 16
TOLERANCE = 0.002
BUCKET_BYTES = 64 << 20
MOST_BUCKETS = 1 << 16


def row_size(text: str) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def row_key(text: str, row_id: str) -> Column:
    low = (1 << 24) - 1
    return F.xxhash64(F.coalesce(F.col(text), F.lit(""))).bitwiseAND(F.lit(~low)).bitwiseOR(F.xxhash64(F.col(row_id).cast("string")).bitwiseAND(F.lit(low)))


def histogram(sized: DataFrame, probes: list[int]) -> tuple[list[int], list[int]]:
    """Exact rows and bytes below each of the sorted ``probes``, and in all."""
    edges = np.array(probes, dtype=np.int64)

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, len(edges) + 1), dtype=np.int64)
        for batch in source:
            at = np.searchsorted(edges, batch.column(0).to_numpy(), side="right")
            np.add.at(n[0], at, 1)
            np.add.at(n[1], at, batch.column(1).to_numpy())
        full = np.flatnonzero(n[0])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (full, n[0][full], n[1][full])], names=["cell", "n", "b"])

    cells = sized.select("key", "size").transform(mapped, count, "cell bigint, n bigint, b bigint").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("b").alias("b")).collect()
    rows, size = [0] * (len(edges) + 1), [0] * (len(edges) + 1)
    for c in cells:
        rows[c.cell], size[c.cell] = c.n, c.b
    return np.cumsum(rows).tolist(), np.cumsum(size).tolist()


@dataclass
class Splitter:
    """Bracket of one boundary: bytes below ``low`` <= target <= below ``high``."""

    target: float
    exact: bool
    low: int = LOW
    high: int = HIGH
    low_bytes: int = 0
    high_bytes: int = 0

    @property
    def best(self) -> tuple[float, int]:
        return min((abs(self.target - self.low_bytes), self.low), (abs(self.high_bytes - self.target), self.high))

    def open(self, tolerance: float) -> bool:
        return self.high - self.low > 1 and self.best[0] > tolerance

    def probes(self) -> list[int]:
        width = self.high - self.low
        return [self.low + width * i // (PROBES + 1) for i in range(1, PROBES + 1)]


def splitters(sized: DataFrame, total: int, shards: int, buckets: int, tolerance: float) -> list[int]:
    """Keys of all bucket boundaries; each ``buckets``-th one bounds a shard."""
    wanted = [Splitter(total * i / (shards * buckets), i % buckets == 0, high_bytes=total) for i in range(1, shards * buckets)]
    room = total / shards
    # Each round narrows every open bracket about 17-fold, so 64 bits need some 16 rounds.
    while True:
        active = [s for s in wanted if s.open(room * (tolerance if s.exact else 0.25 / buckets))]
        if not active:
            break
        probes = sorted({p for s in active for p in s.probes() if s.low < p < s.high})
        if not probes:
            break
        _, below = histogram(sized, probes)
        for s in active:
            at = int(np.searchsorted(below[:-1], s.target, side="right"))
            if at and probes[at - 1] > s.low:
                s.low, s.low_bytes = probes[at - 1], below[at - 1]
            if at < len(probes) and probes[at] < s.high:
                s.high, s.high_bytes = probes[at], below[at]
    keys: list[int] = []
    for s in wanted:
        keys.append(max(s.best[1], keys[-1] if keys else LOW))
    return keys


def shard_rows(
    docs: DataFrame, shards: int = 16, text: str = "text", row_id: str = "doc_id", tolerance: float = TOLERANCE, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """``docs`` in key order with ``shard`` (from 0) and ``slot`` (gapless from 0)."""
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    keyed = docs.withColumns({"__key": row_key(text, row_id), "__size": row_size(text)})
    sized = stored(keyed.select(F.col("__key").alias("key"), F.col("__size").alias("size")), "sizes")
    total = sized.agg(F.sum("size").alias("n")).first().n or 0
    buckets = -(-min(MOST_BUCKETS, max(partitions_for(spark), total // bucket_bytes + 1)) // shards)
    edges = splitters(sized, total, shards, buckets, tolerance) if total else [HIGH] * (shards * buckets - 1)
    edges_np = np.array(edges, dtype=np.int64)
    unique = sorted(set(edges))
    rows_below, _ = histogram(sized, unique)
    below = dict(zip(unique, rows_below, strict=False))
    first = [0, *(below[e] for e in edges)]
    base = np.array([first[i] - first[i - i % buckets] for i in range(len(first))], dtype=np.int64)
    names = keyed.columns
    at = names.index("__key")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema)

    def locate(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            bucket = np.searchsorted(edges_np, batch.column(at).to_numpy(), side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket)], names=[*names, "__bucket"])

    moved = keyed.transform(mapped, locate, schema + ", __bucket int").repartitionById(shards * buckets, "__bucket")
    ordered = moved.sortWithinPartitions("__bucket", "__key", row_id)

    def number(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: dict[int, int] = {}
        for batch in source:
            bucket = batch.column(len(names)).to_numpy()
            slot = np.empty(len(bucket), dtype=np.int64)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo < hi:
                    b = int(bucket[lo])
                    slot[lo:hi] = base[b] + before.get(b, 0) + np.arange(hi - lo)
                    before[b] = before.get(b, 0) + int(hi - lo)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array((bucket // buckets).astype(np.int32)), pa.array(slot)], names=[*names, "shard", "slot"])

    return ordered.transform(mapped, number, schema + ", shard int, slot bigint").drop("__key", "__size")


def digest(sharded: DataFrame, text: str = "text") -> DataFrame:
    return sharded.select(
        "doc_id",
        row_size(text).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
