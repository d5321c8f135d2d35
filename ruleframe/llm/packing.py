"""Variable-capacity best-fit packing of documents into training sequences.

Plan
----
1. Texts become pieces: a text of more units than the largest capacity is cut
   into full pieces and a rest; nothing is dropped.
2. The pieces are counted by length.  Lengths are bounded by the largest
   capacity, so the histogram has a fixed bound whatever the corpus.
3. Best-fit decreasing runs over the histogram.  The longest piece left opens a
   bin.  For each permitted capacity the bin is filled on trial, each time with
   the longest piece left that fits the room, and shrunk to the least capacity
   that holds what it got; the size with the least cost per unit is opened.  So
   all sizes compete for the pieces that are really left.  As many bins are
   opened at once as the counts allow, so the work depends on the number of
   lengths only.  No piece left fits a bin that was closed: a bin is closed when
   nothing left fits its room.
4. Pieces get their rank among those of their length from a range partitioning
   with exact counts, and ranks map to bins by the plan.  No task sees all
   pieces of a length.

Units are words between ASCII white space (the operator's ``length`` column may
be any other count).  Each piece takes one more unit for the separator.

``sequences`` returns the packed sequences themselves: the pieces' words in
their order, each piece closed by the separator.

Defined results: null and empty texts have no units and become one piece of
the separator alone, so every row is packed.  Rows that repeat an id, or have
none, are packed like others.  Only id and text (or length) are read, so other
columns, whatever their names, play no part; an empty table has no bins.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ruleframe.llm.common import checkpointed, mapped, partitions_for

CAPACITIES = (512, 1024, 2048, 4096, 8192)
SEPARATOR = 1
BIN_COST = 16
WORD = r"[^\x20\x09-\x0D]+"
END = "<|end|>"


def unit_count(text: str = "text"):
    """Number of words between ASCII white space, without Python."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def pieces(docs: DataFrame, largest: int, content: bool = False) -> DataFrame:
    """``id, piece, first_unit, units, n [, content]``; full pieces first, then the rest.

    ``docs`` has ``id, length [, words]``.
    """
    room = largest - SEPARATOR
    own = f", array_join(slice(words, i * {room} + 1, {room}), ' ') as content" if content else ""
    each = f"transform(sequence(0, greatest(0, cast(floor((greatest(length, 1) - 1) / {room}) as int))), i -> struct(i as piece{own}))"
    cut = docs.select("id", "length", F.explode(F.expr(each)).alias("p"))
    first = F.col("p.piece").cast("long") * room
    units = F.least(F.lit(room).cast("long"), F.col("length") - first)
    return cut.select("id", "p.piece", first.alias("first_unit"), units.alias("units"), (units + SEPARATOR).alias("n"), *(["p.content"] if content else []))


@dataclass
class Group:
    """``count`` equal bins; ``items`` lists (length, first rank, per bin)."""

    count: int
    capacity: int
    used: int
    items: list[tuple[int, int, int]]


def linear_cost(capacity: int) -> float:
    """What a bin costs: its units and ``BIN_COST`` more for being one."""
    return capacity + BIN_COST


def fitted(used: int, capacities: tuple[int, ...]) -> int:
    return capacities[bisect_left(capacities, used)]


def filled(lengths: list[int], left: dict[int, int], capacity: int) -> tuple[dict[int, int], int]:
    """Pieces of a bin that the longest length opens, and the units they take.

    The room always goes to the longest piece left that fits.
    """
    pattern, room, end = {}, capacity, len(lengths)
    while room and end:
        end = bisect_right(lengths, room, 0, end) - 1
        if end < 0:
            break
        n = lengths[end]
        pattern[n] = min(room // n, left[n])
        room -= n * pattern[n]
    return pattern, capacity - room


def plan(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = linear_cost) -> list[Group]:
    """Groups of equal bins for pieces counted by length, in a fixed order."""
    capacities = tuple(sorted(set(capacities)))
    left = {n: c for n, c in histogram.items() if c}
    lengths = sorted(left)
    rank = dict.fromkeys(lengths, 0)
    done: list[Group] = []
    while lengths:
        best = None
        for capacity in capacities[bisect_left(capacities, lengths[-1]) :]:
            pattern, used = filled(lengths, left, capacity)
            size = fitted(used, capacities)
            # Of equally cheap sizes the largest goes first.
            key = (cost(size) / used, -size)
            if best is None or key < best[0]:
                best = (key, pattern, used, size)
        _, pattern, used, size = best
        count = min(left[n] // k for n, k in pattern.items())
        done.append(Group(count, size, used, [(n, rank[n], k) for n, k in pattern.items()]))
        for n, k in pattern.items():
            rank[n] += k * count
            left[n] -= k * count
            if not left[n]:
                del left[n]
                lengths.pop(bisect_left(lengths, n))
    return done


def _ranked(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each length in this partition."""
    part = TaskContext.get().partitionId()
    total: dict[int, int] = {}
    for batch in source:
        values, counts = np.unique(batch.column(0).to_numpy(), return_counts=True)
        for v, c in zip(values.tolist(), counts.tolist(), strict=True):
            total[v] = total.get(v, 0) + c
    if total:
        yield pa.RecordBatch.from_pydict({"part": pa.array([part] * len(total), pa.int32()), "n": pa.array(list(total), pa.int64()), "count": pa.array(list(total.values()), pa.int64())})


def pack(
    docs: DataFrame, text: str = "text", row_id: str = "doc_id", capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = linear_cost, length: str | None = None, content: bool = False
) -> DataFrame:
    """``<row_id>, piece, first_unit, units, bin_id, bin_capacity, bin_used, bin_offset``.

    ``bin_offset`` is the place of the piece's first unit in its bin.  With
    ``content`` a last column has the piece's words, joined by spaces.
    """
    capacities = tuple(sorted(set(capacities)))
    spark = docs.sparkSession
    kind = docs.schema[row_id].dataType.simpleString()
    counted = docs.select(
        F.col(row_id).alias("id"),
        (F.coalesce(F.col(length), F.lit(0)).cast("long") if length else unit_count(text)).alias("length"),
        *([F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0)).alias("words")] if content else []),
    )
    cut = pieces(counted, capacities[-1], content)
    ordered = cut.repartitionByRange(partitions_for(spark), "n", F.xxhash64("id", "piece"), "id", "piece").sortWithinPartitions("n", "id", "piece")
    ordered = checkpointed(ordered)
    counts = ordered.select("n").transform(mapped, _ranked, "part int, n bigint, count bigint").collect()
    histogram: dict[int, int] = {}
    offsets: dict[int, dict[int, int]] = {}
    for r in sorted(counts, key=lambda r: (r["part"], r["n"])):
        offsets.setdefault(r["part"], {})[r["n"]] = histogram.get(r["n"], 0)
        histogram[r["n"]] = histogram.get(r["n"], 0) + r["count"]
    runs: dict[int, list[tuple[int, ...]]] = {}
    first_bin = 0
    for g in plan(histogram, capacities, cost):
        at = 0
        for n, rank, per in g.items:
            runs.setdefault(n, []).append((rank, per, first_bin, at, g.capacity, g.used))
            at += n * per
        first_bin += g.count
    lookup = {n: np.array(sorted(r), dtype=np.int64) for n, r in runs.items()}
    shared = spark.sparkContext.broadcast((lookup, offsets))
    names = [row_id, "piece", "first_unit", "units", "bin_id", "bin_capacity", "bin_used", "bin_offset", *(["content"] if content else [])]

    def place(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, before = shared.value
        own = dict(before.get(TaskContext.get().partitionId(), {}))
        for batch in source:
            lengths = batch.column(4).to_numpy()
            out = np.empty((4, len(lengths)), dtype=np.int64)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(lengths)) + 1, [len(lengths)]])
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                n = int(lengths[lo])
                rank = own[n] + np.arange(hi - lo)
                own[n] += int(hi - lo)
                run = table[n][np.searchsorted(table[n][:, 0], rank, side="right") - 1]
                inner = rank - run[:, 0]
                out[0, lo:hi] = run[:, 2] + inner // run[:, 1]
                out[1, lo:hi], out[2, lo:hi] = run[:, 4], run[:, 5]
                out[3, lo:hi] = run[:, 3] + (inner % run[:, 1]) * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(x) for x in out), *batch.columns[5:]], names=names)

    schema = f"`{row_id}` {kind}, piece int, first_unit bigint, units bigint, bin_id bigint, bin_capacity bigint, bin_used bigint, bin_offset bigint" + (", content string" if content else "")
    return ordered.transform(mapped, place, schema)


def sequences(docs: DataFrame, text: str = "text", row_id: str = "doc_id", end: str = END, **options) -> DataFrame:
    """The packed sequences: ``bin_id, bin_capacity, bin_used, sequence``.

    A sequence has at most the largest capacity of words, so a bin's pieces have
    a bound.
    """
    placed = pack(docs, text, row_id, content=True, **options)
    each = F.struct("bin_offset", F.when(F.col("units") > 0, F.concat("content", F.lit(" " + end))).otherwise(F.lit(end)).alias("x"))
    joined = placed.groupBy("bin_id", "bin_capacity", "bin_used").agg(F.array_sort(F.collect_list(each)).alias("parts"))
    return joined.select("bin_id", "bin_capacity", "bin_used", F.array_join("parts.x", " ").alias("sequence"))
