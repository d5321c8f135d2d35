"""Exact top-k search by inner product with a vector-approximation file.

Plan
----
1. Components become integers (``floor(scale * x)``).  Of equal vectors only
   the rows of the k + 1 least ids stay: no query can have more among its k.
2. Each dimension is cut into cells of equal width between its least and
   greatest value; a vector's approximation is one byte a dimension.  The
   approximations are a table of their own, in chunks of ``CHUNK`` vectors.
3. Queries are taken in waves of ``WAVE_BYTES``, which go to all tasks; a wave
   is one scan of the approximations.
4. *Filter pass*: the cells bound every inner product from both sides.  A task
   keeps the k greatest lower bounds of each query, and passes on the ids whose
   upper bound reaches the least of them.  The k greatest lower bounds of all
   tasks then rule out most of those.
5. *Refine pass*: candidates are ranked by their upper bound, best first.  The
   exact vectors of the first ``FIRST`` times k are fetched by a join; the k-th
   exact score makes certain which of the others cannot enter, and only the
   rest is fetched.  Vectors that are no candidates are not read.

Defined results: vectors that are null or hold a null or non-finite component
take no part, nor do rows with a null id.  Queries and candidates of different
length are not compared.  A query's own id is no candidate, however often it
occurs; a candidate row given twice counts twice.  Ties go to the smaller id.
Sums that could pass 2**53 are computed with Python integers; a score beyond 64
bits takes the nearest 64-bit integer.  Only id and vector are read, so other
columns, whatever their names, play no part; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ruleframe.llm.common import mapped, stored

CHUNK = 4096
QUERY_ROWS = 256
WAVE_BYTES = 32 << 20
FIRST = 4
HELD = 1 << 20
CELLS = 64
SCALE = 1024
EXACT_FLOAT = float(1 << 53)

VECTORS = "id bigint, dim int, exact binary"


def _quantised(scale: int):
    """Rows (id, vector) as integer components, kept as doubles; rows that take no part go."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            ids, vectors = batch.column(0), batch.column(1)
            sizes = np.nan_to_num(vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
            there = ids.is_valid().to_numpy(zero_copy_only=False)
            # Null lists are left out by flatten, null components become NaN.
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes[there & (sizes > 0)]).tolist():
                at = np.flatnonzero(there & (sizes == dim))
                with np.errstate(over="ignore", invalid="ignore"):
                    x = np.floor(flat[starts[at][:, None] + np.arange(dim)] * scale)
                whole = np.isfinite(x).all(axis=1)
                x, at = x[whole], at[whole]
                exact = pa.FixedSizeBinaryArray.from_buffers(pa.binary(dim * 8), len(at), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)).cast(pa.int64()), pa.array(np.full(len(at), dim, dtype=np.int32)), exact], names=["id", "dim", "exact"])

    return run


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, places in the batch, components by rows) of rows (.., dim, exact)."""
    dims = batch.column(batch.num_columns - 2).to_numpy()
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        exact = batch.column(batch.num_columns - 1).take(pa.array(at)).to_pylist()
        yield dim, at, np.frombuffer(b"".join(exact)).reshape(-1, dim)


def _extent(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least and greatest component of each dimension, a row for each batch."""
    for batch in source:
        for dim, _, v in _matrices(batch):
            columns = [pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array(v.min(axis=0)), pa.array(v.max(axis=0))]
            yield pa.RecordBatch.from_arrays(columns, names=["dim", "axis", "low", "high"])


def _coded(shared):
    """Chunks (dim, ids, codes) of the rows of a task."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            ids = batch.column(0).to_numpy()
            for dim, at, v in _matrices(batch):
                low, step = shared.value[dim]
                codes = np.minimum(np.floor((v - low) / step), CELLS - 1).astype(np.uint8)
                for s in range(0, len(at), CHUNK):
                    part = slice(s, s + CHUNK)
                    columns = [pa.array([dim], pa.int32()), pa.array([ids[at[part]].tobytes()], pa.binary()), pa.array([codes[part].tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["dim", "ids", "codes"])

    return run


def bounds(queries: np.ndarray, codes: np.ndarray, low: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all inner products, queries by rows.

    Cells are widened by a millionth of their width, so rounding is covered.
    """
    floor = low + (codes - 1e-6) * step
    ceil = low + (codes + (1 + 1e-6)) * step
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    slack = 1e-9 * (np.abs(queries) @ np.maximum(np.abs(low), np.abs(low + CELLS * step)))[:, None]
    return up @ floor.T + down @ ceil.T - slack, up @ ceil.T + down @ floor.T + slack


def scores(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products as 64-bit integers."""
    if np.abs(query).max() * np.abs(rows).max() * len(query) < EXACT_FLOAT:
        return (rows @ query).astype(np.int64)
    q = [int(x) for x in query]
    return np.array([max(-(1 << 63), min((1 << 63) - 1, sum(a * int(b) for a, b in zip(q, r, strict=True)))) for r in rows], dtype=np.int64)


class Wave:
    """Queries of one dimension: their numbers, ids and vectors."""

    def __init__(self, rows: list[tuple[int, int, bytes]], dim: int):
        self.numbers = np.array([r[0] for r in rows], dtype=np.int64)
        self.ids = np.array([r[1] for r in rows], dtype=np.int64)
        self.vectors = np.frombuffer(b"".join(r[2] for r in rows)).reshape(-1, dim)


def _bounded(shared, grid, k: int):
    """Candidates (q, vec_id, high) and, with a null id, the k greatest lower bounds of each query."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {dim: np.full((len(w.ids), k), -np.inf) for dim, w in shared.value.items()}
        held: dict[int, list[np.ndarray]] = {dim: [] for dim in best}

        def reaching(dim: int) -> np.ndarray:
            """The held rows (place of the query, id, bound) that still reach their query's threshold."""
            rows = np.concatenate(held[dim], axis=1)
            return rows[:, rows[2].view(np.float64) >= best[dim].min(axis=1)[rows[0]]]

        def passed(dim: int, rows: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(shared.value[dim].numbers[rows[0]]), pa.array(rows[1]), pa.array(rows[2].view(np.float64))], names=["q", "vec_id", "bound"])

        for batch in source:
            for dim, ids, codes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if dim not in best:
                    continue
                wave, kept = shared.value[dim], best[dim]
                ids_np, codes_np = np.frombuffer(ids, dtype=np.int64), np.frombuffer(codes, dtype=np.uint8).reshape(-1, dim)
                for s in range(0, len(wave.ids), QUERY_ROWS):
                    part = slice(s, s + QUERY_ROWS)
                    low, high = bounds(wave.vectors[part], codes_np, *grid.value[dim])
                    own = wave.ids[part][:, None] == ids_np[None, :]
                    low[own], high[own] = -np.inf, -np.inf
                    both = np.concatenate([kept[part], low], axis=1)
                    kept[part] = np.partition(both, -k, axis=1)[:, -k:]
                    near = (high >= kept[part].min(axis=1)[:, None]) & ~own
                    i, j = np.nonzero(near)
                    held[dim].append(np.stack([i + s, ids_np[j], high[i, j].view(np.int64)]))
                if sum(x.shape[1] for x in held[dim]) > HELD:
                    rows = reaching(dim)
                    held[dim] = [rows]
                    if rows.shape[1] > HELD // 2:
                        held[dim] = []
                        yield passed(dim, rows)
        for dim, kept in best.items():
            if held[dim]:
                yield passed(dim, reaching(dim))
            numbers = np.repeat(shared.value[dim].numbers, k)
            found = np.isfinite(kept.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(numbers[found]), pa.nulls(int(found.sum()), pa.int64()), pa.array(kept.ravel()[found])], names=["q", "vec_id", "bound"])

    return run


def _scored(shared):
    """(q, vec_id, score) of rows (q, id, dim, exact)."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[int, dict[int, int]] = {dim: {int(n): i for i, n in enumerate(w.numbers)} for dim, w in shared.value.items()}
        for batch in source:
            numbers = batch.column(0).to_numpy()
            for dim, at, v in _matrices(batch):
                own = places.get(dim, {})
                mine = np.array([own.get(n, -1) for n in numbers[at].tolist()], dtype=np.int64)
                at, v, mine = at[mine >= 0], v[mine >= 0], mine[mine >= 0]
                if len(at):
                    found = np.empty(len(at), dtype=np.int64)
                    order = np.argsort(mine, kind="stable")
                    for part in np.split(order, np.flatnonzero(np.diff(mine[order])) + 1):
                        found[part] = scores(shared.value[dim].vectors[mine[part[0]]], v[part])
                    yield pa.RecordBatch.from_arrays([pa.array(numbers[at]), batch.column(1).take(pa.array(at)), pa.array(found)], names=["q", "vec_id", "score"])

    return run


def _waves(asked: DataFrame, most: int) -> Iterator[dict[int, Wave]]:
    """Queries in blocks of at most ``most`` bytes, numbered within the block."""
    rows: dict[int, list[tuple[int, int, bytes]]] = {}
    size = number = 0
    for r in asked.orderBy("id", "dim", "exact").toLocalIterator():
        rows.setdefault(r.dim, []).append((number, r.id, bytes(r.exact)))
        size, number = size + len(r.exact), number + 1
        if size >= most:
            yield {d: Wave(x, d) for d, x in rows.items()}
            rows, size, number = {}, 0, 0
    if rows:
        yield {d: Wave(x, d) for d, x in rows.items()}


def _wave_results(spark: SparkSession, wave: dict[int, Wave], exact: DataFrame, file: DataFrame, grid, k: int) -> DataFrame:
    shared = spark.sparkContext.broadcast(wave)
    bounded = stored(file.transform(mapped, _bounded(shared, grid, k), "q bigint, vec_id bigint, bound double"), "bounds")
    by_query = Window.partitionBy("q")
    lows = bounded.where("vec_id IS NULL").withColumn("r", F.row_number().over(by_query.orderBy(F.desc("bound")))).where(F.col("r") == k)
    near = bounded.where("vec_id IS NOT NULL").join(lows.select("q", F.col("bound").alias("reach")), "q", "left").where(F.col("reach").isNull() | (F.col("bound") >= F.col("reach")))
    near = stored(near.select("q", "vec_id", "bound").distinct(), "candidates")

    def fetched(candidates: DataFrame) -> DataFrame:
        rows = candidates.select("q", "vec_id").distinct().join(exact, F.col("vec_id") == F.col("id")).select("q", "vec_id", "dim", "exact")
        return rows.transform(mapped, _scored(shared), "q bigint, vec_id bigint, score bigint")

    best_bounds = near.withColumn("r", F.row_number().over(by_query.orderBy(F.desc("bound"), "vec_id"))).where(F.col("r") <= FIRST * k)
    first = stored(fetched(best_bounds), "first-scores")
    kth = first.withColumn("s", F.row_number().over(by_query.orderBy(F.desc("score")))).where(F.col("s") == k).select("q", F.col("score").alias("least"))
    kth = stored(kth, "kth-scores")
    rest = near.join(kth, "q", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least")))
    rest = rest.join(first.select("q", "vec_id").distinct(), ["q", "vec_id"], "left_anti")
    # Most of the rest falls short of the k-th score: it goes before rows of a query meet.
    more = fetched(rest).join(kth, "q", "left").where(F.col("least").isNull() | (F.col("score") >= F.col("least"))).drop("least")
    best = first.unionByName(more).withColumn("rank", F.row_number().over(by_query.orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    names = spark.createDataFrame([(int(n), int(i)) for w in wave.values() for n, i in zip(w.numbers, w.ids, strict=True)], "q bigint, query_id bigint")
    return best.join(names, "q").select("query_id", "rank", "vec_id", "score")


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 10, row_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE, wave_bytes: int = WAVE_BYTES
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best rows of each query."""
    spark = vectors.sparkSession
    every = vectors.select(F.col(row_id).cast("long").alias("id"), F.col(vector).alias("v")).transform(mapped, _quantised(scale), VECTORS)
    least = F.dense_rank().over(Window.partitionBy("dim", "exact").orderBy("id"))
    exact = stored(every.withColumn("r", least).where(F.col("r") <= k + 1).drop("r"), "exact-vectors")
    extent = exact.select("dim", "exact").transform(mapped, _extent, "dim int, axis int, low double, high double").groupBy("dim", "axis").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    axes: dict[int, list] = {}
    for r in sorted(extent.collect(), key=lambda r: (r.dim, r.axis)):
        axes.setdefault(r.dim, []).append((r.low, (r.high - r.low) / CELLS or 1.0))
    grid = spark.sparkContext.broadcast({d: (np.array([a[0] for a in v]), np.array([a[1] for a in v])) for d, v in axes.items()})
    file = stored(exact.transform(mapped, _coded(grid), "dim int, ids binary, codes binary"), "approximations")
    asked = queries.select(F.col(row_id).cast("long").alias("id"), F.col(vector).alias("v")).transform(mapped, _quantised(scale), VECTORS)
    asked = stored(asked.distinct(), "queries")
    parts = [stored(_wave_results(spark, wave, exact, file, grid, k), "wave-results") for wave in _waves(asked, wave_bytes)]
    if not parts:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    return reduce(DataFrame.unionAll, parts)
