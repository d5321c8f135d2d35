"""Aggregated relations kept up to date as rows arrive.

Partial results of the idempotent and of the additive aggregators merge: a
batch is aggregated alone and merged with the state by key, so the old rows are
never read again.  The state is a table that is replaced as a whole, version by
version.  A version counts once its commit marker is there, and the newest such
one on disk is where a new object (a restarted stream) goes on; a batch that is
replayed after a failure finds its version and is not added twice.  The last two
versions are kept.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Merge:
    """Partial columns of an aggregator, how they merge, and the final value."""

    partial: dict[str, Callable[[Column], Column]]
    combine: dict[str, Callable[[str], Column]]
    final: Callable[[], Column]


MERGES: dict[str, Merge] = {
    "+=": Merge({"s": F.sum}, {"s": F.sum}, lambda: F.col("s")),
    "mean=": Merge({"s": F.sum, "n": F.count}, {"s": F.sum, "n": F.sum}, lambda: F.col("s") / F.col("n")),
    "max=": Merge({"s": F.max}, {"s": F.max}, lambda: F.col("s")),
    "min=": Merge({"s": F.min}, {"s": F.min}, lambda: F.col("s")),
    "|=": Merge({"s": F.bool_or}, {"s": F.bool_or}, lambda: F.col("s")),
    "&=": Merge({"s": F.bool_and}, {"s": F.bool_and}, lambda: F.col("s")),
    ":-": Merge({"s": lambda c: F.bool_or(F.lit(True))}, {"s": F.bool_or}, lambda: F.col("s")),
}


@dataclass
class IncrementalRelation:
    """``keys`` -> value of one aggregator, fed batch by batch.

    ``path`` is a folder that all executors share.
    """

    spark: SparkSession
    path: str
    keys: list[str]
    value: str
    aggregator: str
    version: int = field(default=-1, init=False)

    def __post_init__(self) -> None:
        self.version = max(self._versions(), default=-1)

    def _at(self, version: int) -> str:
        return f"{self.path}/version={version}"

    def _files(self, pattern: str) -> tuple:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}")
        system = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return system, [f.getPath() for f in system.globStatus(where) or ()]

    def _versions(self) -> list[int]:
        """Versions with a commit marker."""
        return sorted(int(p.getParent().getName().split("=")[1]) for p in self._files("version=*/_SUCCESS")[1])

    def apply(self, batch: DataFrame, version: int | None = None) -> None:
        """Merge a batch; a version that is already there is left as it is."""
        version = self.version + 1 if version is None else version
        if version <= self.version:
            return
        m = MERGES[self.aggregator]
        rows = batch.groupBy(*self.keys).agg(*(f(F.col(self.value)).alias(n) for n, f in m.partial.items()))
        if self.version >= 0:
            rows = self.spark.read.parquet(self._at(self.version)).unionByName(rows).groupBy(*self.keys).agg(*(f(n).alias(n) for n, f in m.combine.items()))
        rows.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(self._at(version))
        before, self.version = self.version, version
        system, found = self._files("version=*")
        for p in found:
            if int(p.getName().split("=")[1]) < before:
                system.delete(p, True)

    def result(self) -> DataFrame:
        if self.version < 0:
            raise ValueError("no batch has been applied")
        return self.spark.read.parquet(self._at(self.version)).select(*self.keys, MERGES[self.aggregator].final().alias("v"))

    def follow(self, stream: DataFrame, checkpoint: str):
        """Feed a structured stream into the relation, batch by batch."""
        return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: self.apply(df, int(n))).start()
