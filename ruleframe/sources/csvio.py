"""CSV files as relations: rows of strings in, any relation out.

Paths go through Spark's readers and writers, so any store that Spark reads
will do.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, functions as F


def read_csv(spark: Any, path: str, arity: int | None = None) -> DataFrame:
    """All columns as strings ``a0 ..``; missing cells are empty strings."""
    df = spark.read.csv(path, header=False, inferSchema=False)
    n = arity if arity is not None else len(df.columns)
    cells = [F.coalesce(F.col(df.columns[i]), F.lit("")) if i < len(df.columns) else F.lit("") for i in range(n)]
    return df.select(*(c.alias(f"a{i}") for i, c in enumerate(cells)))


def import_csv(session: Any, name: str, arity: int, path: str, file: str = "main") -> None:
    """``:- import_csv(name/arity, "path").``: each row is a fact."""
    session.register(name, read_csv(session.spark, path, arity), file=file)


def export_csv(session: Any, name: str, arity: int, path: str, file: str = "main") -> None:
    """Write a relation's arguments and value; nested values as JSON text."""
    df = session.relation(name, arity, file)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    cells = [F.to_json(c).alias(c) if kinds[c].startswith(("array", "map", "struct")) else F.col(c) for c in df.columns]
    df.select(*cells).write.mode("overwrite").csv(path, header=False)
