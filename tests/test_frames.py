"""Rules over DataFrames, against DuckDB and against the evaluator over values."""

from pathlib import Path

import duckdb
import pytest

from ruleframe import queries
from ruleframe.plans.terms import RuleError, UnsafeRuleError
from ruleframe.session import Session
from ruleframe.streaming.incremental import MERGES, IncrementalRelation

DATA = "/root/testdata/sf0.001"


def normal(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.skipif(not Path(DATA).exists(), reason="the given tables are not here")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    got = queries.QUERIES[name](spark, DATA)
    found = con.execute(queries.ORACLE_SQL[name])
    order = [d[0] for d in found.description]
    assert sorted(order) == sorted(got.columns)
    assert normal(got.select(*order).collect()) == normal(found.fetchall())


def session(spark):
    s = Session(spark)
    s.register("t", spark.createDataFrame([(1, "a", 2.0), (2, "b", 3.0), (2, "b", 4.0), (3, None, 5.0)], "k int, s string, x double"), ["k", "s"], "x")
    return s


def test_missing_values_are_no_rows(spark):
    s = session(spark)
    s.execute("n += 1 for _ = t(_,S), string(S). c(S) += 1 for _ = t(_,S).")
    assert [tuple(r) for r in s.relation("n", 0).collect()] == [(3,)]
    assert normal(s.relation("c", 1).collect()) == [("a", 1), ("b", 2)]


def test_conflicts_and_unsafe_rules(spark):
    s = session(spark)
    s.execute("u(K) = X for X = t(K,_). f(K,Z) += 1 for _ = t(K,_).")
    with pytest.raises(Exception, match="several values"):
        s.relation("u", 1).collect()
    with pytest.raises(UnsafeRuleError):
        s.relation("f", 2)
    s.execute("loop(X) :- loop(X), _ = t(X,_).")
    with pytest.raises(RuleError):
        s.relation("loop", 1)


def test_queries_and_assertions_over_frames(spark):
    s = session(spark)
    df = s.query("X > 3, X = t(2, S)?")
    assert [tuple(r) for r in df.select("S", "X").collect()] == [("b", 4.0)]
    s.execute("assert t(1, \"a\") > 1.0. assert_fails t(1, \"zzz\") > 1.0.")


def test_plans_prune_and_push_down(spark):
    s = Session(spark)
    s.register("o", spark.read.parquet(f"{DATA}/orders.parquet"), ["o_orderkey", "o_custkey", "o_orderstatus"], "o_totalprice")
    s.execute("r(C) max= P for P = o(_,C,_), P > 1000.0.")
    plan = s.explain("r", 1)
    assert "o_orderstatus" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert "GreaterThan(o_totalprice,1000.0)" in plan


def test_incremental_equals_recomputed(spark, tmp_path):
    rows = [(i % 3, float(i * 7 % 11)) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, x double")
    from pyspark.sql import functions as F

    want = {"+=": F.sum("x"), "mean=": F.avg("x"), "max=": F.max("x"), "min=": F.min("x")}
    for op, agg in want.items():
        rel = IncrementalRelation(spark, f"{tmp_path}/{op[:-1].replace('+', 'sum')}", ["k"], "x", op)
        rel.apply(df.where("k = 0 or x > 4"))
        rel.apply(df.where("not (k = 0 or x > 4)"))
        rel.apply(df, version=1)  # a replay changes nothing
        assert normal(rel.result().collect()) == normal(df.groupBy("k").agg(agg.alias("v")).collect())
    assert set(MERGES) >= set(want)


def test_stream_feeds_a_relation(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, 2), (2, 3)], "k long, x long").write.parquet(source)
    rel = IncrementalRelation(spark, str(tmp_path / "state"), ["k"], "x", "+=")
    q = rel.follow(spark.readStream.schema("k long, x long").parquet(source), str(tmp_path / "cp"))
    q.processAllAvailable()
    spark.createDataFrame([(1, 5)], "k long, x long").write.mode("append").parquet(source)
    q.processAllAvailable()
    q.stop()
    assert normal(rel.result().collect()) == [(1, 7), (2, 3)]


def test_csv_import_pragma(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,1\ny,2\n")
    s = Session(spark)
    s.execute(f':- import_csv(row/3, "{tmp_path}/a.csv").\nr(A, B, C) :- row(A, B, C).')
    assert normal(s.relation("r", 3).collect()) == [("x", "1", "", True), ("y", "2", "", True)]
