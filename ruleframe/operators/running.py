"""Running aggregates: for each asking row, the aggregate of the given rows that
stand before it.

Both sides are laid out once in the order of keys and places.  A partition
aggregates its own rows, and what the earlier partitions hold of the same key is
added from their totals (a row for each key and partition).  So neither a key
that holds most rows nor the lack of any key puts all rows into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ruleframe.plans.fixpoint import checkpointed

FOLDS = {"+=": F.sum, "max=": F.max, "min=": F.min}


def _merged(aggregator: str, a: Column, b: Column) -> Column:
    if aggregator == "+=":
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
    return F.greatest(a, b) if aggregator == "max=" else F.least(a, b)


def running_aggregate(asks: DataFrame, gives: DataFrame, keys: list[str], arity: int, op: str, aggregator: str, whole: bool) -> DataFrame:
    """``a0 .., v`` for each row of ``asks`` (keys, ``at``, ``a0`` ..).

    ``v`` aggregates the values of the rows of ``gives`` (keys, ``at``, ``v``)
    of equal keys whose ``at`` is ``op`` that of the asking row; rows without
    any are left out.  Equal asking rows are computed once.
    """
    fold, heads = FOLDS[aggregator], [f"a{i}" for i in range(arity)]
    wide = (lambda c: c.cast("decimal(38,0)")) if whole and aggregator == "+=" else (lambda c: c)
    given = gives.groupBy(*keys, "at").agg(wide(fold(wide(F.col("v")))).alias("v"))
    asked = asks.groupBy(*keys, "at", *heads).agg(F.count(F.lit(1)).alias("times"))
    # What has an equal place comes first where it counts, later where it does not.
    first = F.lit(0 if "=" in op else 2)
    rows = given.withColumn("side", first).unionByName(asked.withColumn("side", F.lit(1)), allowMissingColumns=True)
    place = F.col("at").asc() if op.startswith("<") else F.col("at").desc()
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = checkpointed(rows.repartitionByRange(parts, *keys, place, "side").withColumn("part", F.spark_partition_id()))
    totals = laid.groupBy(*keys, "part").agg(fold("v").alias("total"))
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.withColumn("before", wide(fold("total").over(earlier))).drop("total")
    own = Window.partitionBy(*keys, "part").orderBy(place, "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = laid.withColumn("inside", wide(fold("v").over(own))).where(F.col("side") == 1)
    found = inside.join(before, [*keys, "part"])
    value = _merged(aggregator, F.col("inside"), F.col("before"))
    if aggregator == "+=":
        value = wide(value * F.col("times"))
    return found.withColumn("v", value).where(F.col("v").isNotNull()).select(*heads, "v")
