"""Products of two relations over a shared argument, block by block.

``f(A, B) += p(A, L) * q(B, L)`` has as many results as there are pairs of A
and B, and more rows before the sum.  Shuffling those by (A, B) takes many
times the space of the relations.  Here A and B are dealt into blocks, and each
pair of blocks is one cell: the rows of a block go to all its cells, and a cell
holds all that its results need.  So only rows of the relations are shuffled,
once for each block of the other side, and no result is.

Within a cell the values of one L after another are multiplied out and added,
to pairs that have that L on both sides; no other pair gets a result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from math import ceil
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, DataType, DateType, DecimalType, DoubleType, LongType, StringType, StructField, StructType, TimestampType

#: Fewer rows before the sum than this, or than this many for each row sent to a cell, are shuffled as they are.
LEAST_ROWS, LEAST_GAIN = 1_000_000, 4
#: Most keys of a block: a cell has 2,000 x 2,000 sums, 32 MB.
BLOCK = 2_000
#: Most rows of a block on average, and of one key.
BLOCK_ROWS = 500_000
MOST_TASKS, BATCH = 20_000, 1 << 17
# Executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def simple(t: DataType) -> bool:
    """Types whose equal values are the same to Spark and to Arrow."""
    return isinstance(t, (LongType, StringType, BooleanType, DateType, TimestampType, DecimalType))


def blocks(keys: int, rows: int) -> int:
    """At least four, where there are enough keys for that."""
    return max(1, ceil(keys / BLOCK), ceil(rows / BLOCK_ROWS), min(4, keys // 250))


def block_product(left: DataFrame, right: DataFrame) -> DataFrame | None:
    """``a0 .., b0 .., v`` from ``a0 .., l, v`` and ``b0 .., l, v``, each with one
    row for its keys and ``l``; None where shuffling the pairs costs less or a
    single key has too many rows for a cell."""
    sides, names = (left, right), [[c for c in df.columns if c not in ("l", "v")] for df in (left, right)]
    sizes = [df.groupBy(*n).count().agg(F.count(F.lit(1)), F.sum("count"), F.max("count")).first() for df, n in zip(sides, names, strict=True)]
    if not all(n and most <= BLOCK_ROWS for n, _, most in sizes):
        return None
    met = left.groupBy("l").agg(F.count(F.lit(1)).cast("double").alias("x")).join(right.groupBy("l").agg(F.count(F.lit(1)).cast("double").alias("y")), "l")
    pairs = met.agg(F.sum(F.col("x") * F.col("y"))).first()[0] or 0.0
    g, h = (blocks(n, rows) for n, rows, _ in sizes)
    if pairs < max(LEAST_ROWS, LEAST_GAIN * (sizes[0][1] * h + sizes[1][1] * g)):
        return None
    return _cells(left, right, names, g, h)


def _cells(left: DataFrame, right: DataFrame, names: list[list[str]], g: int, h: int) -> DataFrame:
    def dealt(df: DataFrame, keys: list[str], own: int, other: int, side: int) -> DataFrame:
        block = F.pmod(F.xxhash64(*keys), F.lit(own).cast("bigint"))
        others = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(other - 1).cast("bigint")))
        rows = df.select(block.alias("own"), others.alias("other"), "l", *keys, "v")
        at = F.col("own") * h + F.col("other") if side == 0 else F.col("other") * h + F.col("own")
        return rows.select(at.alias("cell"), F.lit(side).alias("side"), "l", *keys, "v")

    rows = dealt(left, names[0], g, h, 0).unionByName(dealt(right, names[1], h, g, 1), allowMissingColumns=True)
    rows = rows.repartition(min(g * h, MOST_TASKS), "cell").sortWithinPartitions("cell")
    types = {f.name: f.dataType for df in (left, right) for f in df.schema}
    schema = StructType([*(StructField(c, types[c]) for n in names for c in n), StructField("v", DoubleType())])
    return rows.mapInArrow(lambda batches: multiplied(batches, *names), schema)


def multiplied(batches: Iterator[Any], left: list[str], right: list[str]) -> Iterator[Any]:
    """The results of one cell after another; its rows follow each other."""
    import numpy as np
    import pyarrow as pa

    held: list[Any] = []
    for batch in batches:
        cells = batch.column("cell").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            if start == end:
                continue
            if held and held[0].column("cell")[0].as_py() != cells[start]:
                yield from _cell(pa.Table.from_batches(held), left, right)
                held = []
            held.append(batch.slice(start, end - start))
    if held:
        yield from _cell(pa.Table.from_batches(held), left, right)


def _numbered(table: Any, names: list[str]) -> tuple[Any, list[Any]]:
    """A number for the keys of each row, and the keys by number."""
    import numpy as np

    code = np.zeros(table.num_rows, dtype=np.int64)
    for c in names:
        own = table.column(c).combine_chunks().dictionary_encode()
        code = np.unique(code * max(1, len(own.dictionary)) + own.indices.to_numpy(), return_inverse=True)[1]
    first = np.unique(code, return_index=True)[1]
    return code, [table.column(c).combine_chunks().take(first) for c in names]


def _cell(table: Any, left: list[str], right: list[str]) -> Iterator[Any]:
    import numpy as np
    import pyarrow as pa

    place = table.column("l").combine_chunks().dictionary_encode().indices.to_numpy()
    side, value = table.column("side").to_numpy(), table.column("v").to_numpy()
    parts, keys = [], []
    for number, names in enumerate((left, right)):
        own = np.flatnonzero(side == number)
        if not len(own):
            return
        code, found = _numbered(table.take(own), names)
        order = np.lexsort((code, place[own]))
        at = place[own][order]
        places, starts = np.unique(at, return_index=True)
        parts.append((code[order], value[own][order], dict(zip(places.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(at)], strict=True), strict=True))))
        keys.append(found)
    (a, x, at_a), (b, y, at_b) = parts
    n, m = len(keys[0][0]), len(keys[1][0])
    total, seen = np.zeros((n, m)), np.zeros((n, m), dtype=bool)
    with np.errstate(all="ignore"):
        for p in sorted(at_a.keys() & at_b.keys()):
            i, j = slice(*at_a[p]), slice(*at_b[p])
            if i.stop - i.start == n and j.stop - j.start == m:
                # All keys, each once and in order.
                total += np.multiply.outer(x[i], y[j])
                seen[:] = True
            else:
                cross = np.ix_(a[i], b[j])
                total[cross] += np.multiply.outer(x[i], y[j])
                seen[cross] = True
    hits, total = np.flatnonzero(seen), total.ravel()
    for start in range(0, len(hits), BATCH):
        own = hits[start : start + BATCH]
        columns = [*(k.take(own // m) for k in keys[0]), *(k.take(own % m) for k in keys[1]), pa.array(total[own])]
        yield pa.RecordBatch.from_arrays(columns, [*left, *right, "v"])
