"""Recursive functors over DataFrames: a semi-naive loop on the driver.

All functors of a cycle are computed together.  Aggregators that may merge a
delta (``min= max= :- |= &= ?=``) join only the rows that changed in the last
round, once for each place where a rule calls a functor of the cycle; of what
they give, only rows that are new or better (``min= max=``) go on.  The
others (sums, products, means, lists, unique and overriding values) recompute
their groups from all contributions until nothing changes.

Every round is cut from its lineage by a reliable checkpoint in the shared
folder, so a lost executor costs a re-read and plans do not grow.
"""

from __future__ import annotations

import re
import tempfile
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from ruleframe.operators.aggregators import AGGREGATORS
from ruleframe.plans.compile import Compiler, called, united
from ruleframe.plans.terms import RuleError

MOST_ROUNDS = 1000
#: When a value replaces a known one.
BETTER = {"min=": lambda new, old: new < old, "max=": lambda new, old: new > old, ":-": lambda new, old: F.lit(False)}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only where
    that is unset and all runs in one process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("ruleframe.rounds.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuleError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="ruleframe-rounds-")
        spark.conf.set("ruleframe.rounds.dir", named)
        spark.sparkContext.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def improved(found: DataFrame, full: DataFrame, arity: int, op: str) -> DataFrame:
    """Rows that are new or better than what is known; all others end here and lead to no further rows."""
    keys = [f"a{i}" for i in range(arity)]
    known = full.select(*keys, F.col("v").alias("__known"))
    better = BETTER[op](F.col("v"), F.col("__known"))
    return checkpointed(found.join(known, keys, "left").where(F.col("__known").isNull() | better).select(*keys, "v"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables, each with one row a key, hold the same rows.

    Counts and hashes are compared, so nothing is shuffled; maps have no hash.
    """
    if a.dtypes != b.dtypes:
        return False
    if any("map<" in kind for _, kind in a.dtypes):
        return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    first, second = (df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*df.columns)), F.bit_xor(F.xxhash64(*reversed(df.columns)))).first() for df in (a, b))
    return tuple(first) == tuple(second)


def cycle(compiler: Compiler, functor: Any) -> list[Any]:
    """The functors that call each other with this one."""
    keys = {functor.key} | {k for k in compiler.depends(functor) if functor.key in compiler.depends(compiler.session.functors[k])}
    return [compiler.session.functors[k] for k in sorted(keys)]


def solve(compiler: Compiler, functor: Any) -> dict[tuple, DataFrame]:
    members = cycle(compiler, functor)
    inside = {f.key for f in members}
    session = compiler.session

    def own_calls(r: Any) -> list[Any]:
        return [g for g in r.part.goals if g.kind == "call" and (f := session.functor(g.name, len(g.args), r.file)) is not None and f.key in inside]

    def touches(r: Any) -> bool:
        return any((f := session.functor(n, a, r.file)) is not None and f.key in inside for n, a in called(r.part))

    incremental = all(AGGREGATORS[r.aggregator].idempotent and len({x.aggregator for x in f.rules}) == 1 and r.part.key is None for f in members for r in f.rules)
    incremental &= all(bool(own_calls(r)) == touches(r) for f in members for r in f.rules)
    full: dict[tuple, DataFrame] = {}
    for f in members:
        base = [r for r in f.rules if not touches(r)]
        if not base:
            raise RuleError(f"{f.name}/{f.arity} only depends on itself")
        full[f.key] = checkpointed(compiler.combined(base, compiler.contribution))
    delta = dict(full)
    try:
        for _ in range(MOST_ROUNDS):
            compiler.pending.update(full)
            new: dict[tuple, DataFrame] = {}
            fresh: dict[tuple, DataFrame | None] = {}
            for f in members:
                if incremental:
                    found = []
                    for r in f.rules:
                        for g in own_calls(r):
                            changed = delta[session.functor(g.name, len(g.args), r.file).key]
                            if changed is not None:
                                found.append(compiler.contribution(r, override={id(g): changed}))
                    if not found:
                        new[f.key] = full[f.key]
                        continue
                    op = f.rules[0].aggregator
                    if op in BETTER and f.arity:
                        better = improved(compiler.aggregated(united([x.drop("n") for x in found]), f.arity, op), full[f.key], f.arity, op)
                        if better.isEmpty():
                            fresh[f.key], new[f.key] = None, full[f.key]
                        else:
                            keys = [f"a{i}" for i in range(f.arity)]
                            fresh[f.key], new[f.key] = better, checkpointed(full[f.key].join(better, keys, "left_anti").unionByName(better))
                        continue
                    new[f.key] = checkpointed(compiler.aggregated(united([full[f.key], *(x.drop("n") for x in found)]), f.arity, op))
                else:
                    new[f.key] = checkpointed(compiler.combined(f.rules, compiler.contribution))
            settled = True
            for f in members:
                if f.key in fresh:
                    delta[f.key] = fresh[f.key]
                    settled &= fresh[f.key] is None
                elif new[f.key] is full[f.key]:
                    delta[f.key] = None
                elif incremental:
                    changed = new[f.key].exceptAll(full[f.key])
                    delta[f.key] = None if changed.isEmpty() else changed
                    settled &= delta[f.key] is None
                else:
                    # Only whether anything changed matters here, not what.
                    settled &= same_rows(new[f.key], full[f.key])
            full = new
            if settled:
                return full
    finally:
        for key in inside:
            compiler.pending.pop(key, None)
    raise RuleError(f"{functor.name}/{functor.arity} does not settle within {MOST_ROUNDS} rounds")
