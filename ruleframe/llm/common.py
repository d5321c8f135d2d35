"""Helpers shared by the corpus operators: durable tables, text normalising."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: ASCII white space of the contracts: space and the range tab..carriage return.
ASCII_SPACE = b" \t\n\x0b\x0c\r"
#: Most bytes of an Arrow batch between Spark and a Python worker.
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
#: Bits of the array that tells which rows may have a partner, at most.
ID_BITS = 24


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset
    and all runs in one process (tests) a temporary folder is made and kept in
    the session.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    made = spark.conf.get("ruleframe.shared.dir", None)
    if not made:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        made = "file://" + tempfile.mkdtemp(prefix="ruleframe-shared-")
        spark.conf.set("ruleframe.shared.dir", made)
        spark.sparkContext.setCheckpointDir(made)
    return made


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: a lost executor costs at most the tasks that read the
    table, never the plan that made it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


_written: dict[str, list[str]] = {}


def release(spark: SparkSession, keep: tuple[DataFrame, ...] = ()) -> int:
    """Delete the tables that ``stored`` has written in this application, but for ``keep``.

    For use once their readers are done, as a result is read lazily.  Returns
    the number of tables deleted.
    """
    kept = {getattr(df, "stored_path", None) for df in keep}
    paths = _written.get(spark.sparkContext.applicationId, [])
    gone = [p for p in paths if p not in kept]
    for p in gone:
        discard_path(spark, p)
    _written[spark.sparkContext.applicationId] = [p for p in paths if p in kept]
    return len(gone)


def discard_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in tables:
        discard_path(df.sparkSession, df.stored_path)
        _written[df.sparkSession.sparkContext.applicationId].remove(df.stored_path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint that keeps the partitions and the order of rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with a bound on the memory of its tasks.

    Batches of the session get at most ``BATCH_BYTES``.  Workers live on between
    tasks, so they give free memory back to the system when a task ends; else
    each would keep the most that any of its tasks took.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_CONF) != str(BATCH_BYTES):
        conf.set(BATCH_CONF, str(BATCH_BYTES))

    def whole(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(source)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return df.mapInArrow(whole, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def strings(column: pa.Array) -> list[str | None]:
    return column.to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit integers (the splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=np.uint64).view(np.int64)


def batches(schema: pa.Schema, rows: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x := rows[f.name], pa.Array) else pa.array(x, type=f.type) for f in schema], schema=schema)


def likely(source: DataFrame, ids: DataFrame, name: str = "id") -> DataFrame:
    """Rows of ``source`` whose ``name`` may be in ``ids``; none that is goes missing.

    A bit array over hashes of the ids, of at most ``2 ** ID_BITS`` bits, goes
    to the tasks, so rows without a partner need not be shuffled for a join.
    """
    spark = source.sparkSession
    bits = max(10, min(ID_BITS, int(ids.count() * 16).bit_length()))
    place = F.xxhash64(name).bitwiseAND(F.lit((1 << bits) - 1))
    cells = ids.select(F.shiftright(place, 3).alias("byte"), F.pow(F.lit(2.0), place.bitwiseAND(F.lit(7))).cast("int").alias("bit"))
    got = cells.groupBy("byte").agg(F.bit_or("bit").alias("bit")).toArrow()
    array = np.zeros(1 << (bits - 3), dtype=np.uint8)
    array[got.column("byte").to_numpy()] = got.column("bit").to_numpy().astype(np.uint8)
    shared = spark.sparkContext.broadcast(array)
    names = source.columns

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            at = batch.column(len(names)).to_numpy()
            keep = (shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            yield pa.RecordBatch.from_arrays(batch.columns[: len(names)], names=names).filter(pa.array(keep.astype(bool)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    return source.withColumn("__place", place).transform(mapped, run, schema)
