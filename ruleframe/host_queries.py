"""Registered queries of what a program shares with its host: sessions, files,
values, pragmas, printing and the interactive loop, with SQL that says the same.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ruleframe.plans.fixpoint import shared_dir
from ruleframe.plans.terms import AssertionFailed, RuleError, Term
from ruleframe.session import Session

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def values(*rows: tuple) -> str:
    """SQL of rows (k, v) of strings."""
    cells = ", ".join("(" + ", ".join("'" + str(c).replace("'", "''") + "'" for c in r) + ")" for r in rows)
    return f"SELECT k, v FROM (VALUES {cells}) t(k, v)"


def rows(spark: SparkSession, found: dict) -> DataFrame:
    return spark.createDataFrame([(str(k), str(v)) for k, v in found.items()], "k string, v string")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(df: DataFrame, *columns: str) -> DataFrame:
    """The first columns under other names; sums of 38 digits as 64 bits."""
    cells = [F.col(old).cast("bigint") if kind.startswith("decimal") else F.col(old) for old, kind in df.dtypes]
    return df.select(*(c.alias(n) for c, n in zip(cells, columns, strict=False)))


@query("SELECT CAST(n_regionkey AS BIGINT) r, CAST(count(*) AS BIGINT) n FROM nation GROUP BY 1")
def host_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A DataFrame and a number handed to a program."""
    s = Session(spark)
    s.register("given", read(spark, sf_dir, "nation"), ["n_nationkey", "n_regionkey"])
    s.execute("r(R) += $0 for given(_, R).", 1)
    return named(s.relation("r", 1), "r", "n")


@query("SELECT s_suppkey k, s_acctbal b FROM supplier WHERE s_acctbal > 5000")
def query_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a query over a table, with its free variables as columns."""
    s = Session(spark)
    s.register("supp", read(spark, sf_dir, "supplier"), ["s_suppkey"], "s_acctbal")
    return s.query("B > $0, B = supp(K)?", 5000.0).select(F.col("K").alias("k"), F.col("B").alias("b"))


@query(values(("line 0", "17"), ("line 1", '["a", b[2]]'), ("line 2", "no results")))
def print_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(spark)
    s.execute('print 8 + 9. print ["a", &b(2)]. print nothing(4).')
    return rows(spark, {f"line {i}": t for i, t in enumerate(s.printed)})


@query("SELECT CAST(n_nationkey AS VARCHAR) k, n_name v FROM nation")
def read_csv_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``$read_csv`` gives a file as a list of lists of strings."""
    path = f"{shared_dir(spark)}/read-{uuid.uuid4().hex}"
    read(spark, sf_dir, "nation").select("n_nationkey", "n_name").write.csv(path)
    s = Session(spark)
    s.execute("row(K, V) :- in_list([K, V], $read_csv($0)).", path)
    return named(s.relation("row", 2), "k", "v")


@query("SELECT CAST(r AS VARCHAR) k, CAST(n AS VARCHAR) v FROM (SELECT n_regionkey r, count(*) n FROM nation GROUP BY 1)")
def command_line_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV files named on the command line, in and out."""
    from ruleframe import repl

    folder = f"{shared_dir(spark)}/flags-{uuid.uuid4().hex}"
    read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").write.csv(f"{folder}/in")
    flags = ["--import-csv", "nat/2", f"{folder}/in", "--export-csv", "r/1", f"{folder}/out"]
    repl.command([*flags, "--text", "r(R) += 1 for nat(_, R)."], Session(spark))
    return spark.read.csv(f"{folder}/out").select(F.col("_c0").alias("k"), F.col("_c1").alias("v"))


@query(values(("0", "north"), ("1", "south")))
def program_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(spark)
    s.arguments = ["north", "south"]
    s.execute("arg(A) :- in_list(A, $command_line_args).")
    return rows(spark, {i: r.a0 for i, r in enumerate(s.relation("arg", 1).orderBy("a0").collect())})


@query("SELECT s_suppkey k, CAST(floor(s_acctbal / 1000) AS BIGINT) v FROM supplier")
def host_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A host function that takes whole columns."""
    s = Session(spark)
    s.register("supp", read(spark, sf_dir, "supplier"), ["s_suppkey"], "s_acctbal")
    s.define_function("thousands", 1, returns="bigint", batch=True)(lambda x: (x // 1000).astype("int64"))
    s.execute("r(K) = thousands(supp(K)).")
    return named(s.relation("r", 1), "k", "v")


@query("SELECT CAST(k AS BIGINT) k, list_sort(list(CAST(v AS BIGINT))) v FROM (SELECT n_regionkey k, n_nationkey v FROM nation) GROUP BY 1")
def list_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``list`` and ``list(int)`` as tests of a column."""
    s = Session(spark)
    s.register("nat", read(spark, sf_dir, "nation"), ["n_nationkey", "n_regionkey"])
    s.execute("l(R) concat_list= [K] for nat(K, R). r(R) = L for L = l(R), list(L), list(int, L), !list(string, L).")
    return named(s.relation("r", 1), "k", "v")


@query(values(("boat is a boat", "True"), ("ferry is a boat", "True"), ("boat is a ferry", "False")))
def object_instance(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(spark)
    s.execute("boat = { seats = 4. }. ferry = new boat { cars = 30. }.")
    asked = {"boat is a boat": ("boat", "boat"), "ferry is a boat": ("boat", "ferry"), "boat is a ferry": ("ferry", "boat")}
    return rows(spark, {k: s.query(f"instance({a}, {b})?") for k, (a, b) in asked.items()})


@query("SELECT CAST(n_nationkey AS BIGINT) k, 'known' v FROM nation")
def ground_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(spark)
    s.register("nat", read(spark, sf_dir, "nation"), ["n_nationkey"])
    s.execute('r(K) = "known" for nat(K), $ground(K). r(K) = "free" for nat(K), $free(K).')
    return named(s.relation("r", 1), "k", "v")


@query("SELECT p_partkey k, CASE WHEN p_size < 25 THEN 'number' ELSE 'text' END v FROM part")
def union_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An argument of one type or another, over values that a table asks for."""
    s = Session(spark)
    s.register("part", read(spark, sf_dir, "part"), ["p_partkey", "p_size"])
    s.execute('kind(X:int | float) := "number". kind(X:string | bool) := "text". r(K) := kind(S) for part(K, S), S < 25. r(K) := kind(str(S)) for part(K, S), S >= 25.')
    return named(s.relation("r", 1), "k", "v")


@query("SELECT c_custkey k, bool_or(o_totalprice > 0) v FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def saturated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``:-`` and ``|=`` need one witness only."""
    s = Session(spark)
    s.register("cust", read(spark, sf_dir, "customer"), ["c_custkey"])
    s.register("ord", read(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey"], "o_totalprice")
    s.execute("any(C) :- cust(C), P = ord(_, C), P > 0. r(C) |= P > 0 for any(C), P = ord(_, C).")
    return named(s.relation("r", 1), "k", "v")


@query("SELECT CAST(k AS BIGINT) k, v FROM (SELECT n_nationkey k, 'nation' v FROM nation UNION ALL SELECT r_regionkey + 100, 'region' FROM region)")
def indexed_disjunct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relation of several rules, each with a table of its own."""
    s = Session(spark)
    s.register("nat", read(spark, sf_dir, "nation"), ["n_nationkey"])
    s.register("reg", read(spark, sf_dir, "region"), ["r_regionkey"])
    s.execute('place(K) = "nation" for nat(K). place(K) = "region" for reg(R), K = R + 100.')
    return named(s.relation("place", 1), "k", "v")


@query(values(("same", "True"), ("other", "False")))
def self_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(spark)
    s.execute("mark(N) = *.")
    return rows(spark, {"same": s.query("mark(4) == mark(4)?"), "other": s.query("mark(4) == mark(5)?")})


@query(values(("error", "no such berth"), ("assert", "AssertionFailed"), ("syntax", "SyntaxProblem")))
def program_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, found = Session(spark), {}
    try:
        s.execute('berth(N) = $error("no such berth") for N > 9. assert berth(12) = 1.')
    except RuleError as e:
        found["error"] = e
    for name, text in (("assert", "assert 2 > 3."), ("syntax", "f(1")):
        try:
            s.execute(text)
        except RuleError as e:
            found[name] = type(e).__name__
    return rows(spark, found)


@query(values(("eval", "42"), ("call", "33"), ("ast", "leaf[9]")))
def evaluated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ruleframe.plans.terms import show

    s = Session(spark)
    s.execute("scale(K, X) = K * X.")
    return rows(spark, {"eval": s.query('$eval("6 * 7")?'), "call": s.query("$call(&scale(3), 11)?"), "ast": show(s.query("$ast'{leaf(9)}?"))})


@query(values(("unit", "km"), ("note", "seen by 2 parts")))
def custom_pragma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pragmas that the host handles."""
    s, found = Session(spark), {}
    s.pragmas["unit"] = lambda session, parts, file: found.update(unit=parts[0])
    s.pragmas["note"] = lambda session, parts, file: found.update(note=f"seen by {len([p for p in parts if p != ','])} parts")
    s.execute(':- unit "km".\n:- note a/1, b/2.')
    return rows(spark, found)


@query("SELECT CAST(i AS BIGINT) r, CAST(j AS BIGINT) c, CAST(v AS BIGINT) v FROM (VALUES (1,1,7),(1,2,10),(2,1,15),(2,2,22)) t(i,j,v)")
def library_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A library that comes along, imported by name."""
    s = Session(spark)
    s.execute(':- import "linear".\nm(1,1) = 1. m(1,2) = 2. m(2,1) = 3. m(2,2) = 4. p(R,C) = product(&m, &m, R, C).')
    return named(s.relation("p", 2), "r", "c", "v")


@query(values(("written", "['z', 'y', 'z']"), ("ends", "odd"), ("chained", "['y', 'z', 'z']")))
def library_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(spark)
    s.execute(
        ':- import "machine".\narc("even", "a") = ["z", "odd"]. arc("odd", "a") = ["y", "even"]. arc("even", "b") = ["z", "even"]. arc("odd", "b") = ["y", "odd"].'
        ' back("even", "z") = ["y", "odd"]. back("odd", "z") = ["z", "odd"]. back("even", "y") = ["y", "even"]. back("odd", "y") = ["z", "odd"].'
    )
    text = '["a", "a", "a"]'
    asked = {"written": f'written(&arc, "even", {text})?', "ends": f'ends(&arc, "even", {text})?', "chained": f'chained(&arc, &back, "even", {text})?'}
    return rows(spark, {k: s.query(q) for k, q in asked.items()})


@query(values(("ship sails", "True"), ("sails ship", "False"), ("old old ship sails", "True")))
def library_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(spark)
    s.execute(':- import "grammar".\nr("say", "thing", "act"). r("thing", "mood", "thing"). w("thing", "ship"). w("act", "sails"). w("mood", "old"). ok(T) := false for list(T). ok(T) := true for spells(&r, &w, "say", T).')
    asked = ["ship sails", "sails ship", "old old ship sails"]
    return rows(spark, {t: s.query("ok($0)?", t.split()) for t in asked})


@query(values(("before", "54"), ("after", "144"), ("global", "6")))
def program_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results follow the program; names of one file can be made global."""
    s = Session(spark)
    s.execute("mass(1) += 2. mass(N) += mass(N - 1) * 3 for N > 1.")
    before = s.query("mass(4)?")
    s.execute("mass(2) += 10.")
    s.execute(":- make_global_term wide/1.\nwide(X) = X * 2.", file="elsewhere")
    return rows(spark, {"before": before, "after": s.query("mass(4)?"), "global": s.query("wide(3)?")})


@query(values(("turns", "late/1 early/1"), ("early(1)", "10"), ("late(2)", "40")))
def memo_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is kept in full is computed by priority, and printed from its table."""
    s = Session(spark)
    s.execute('early(X) := X * 10 for range(1, 3, X). late(X) := X * 20 for range(1, 3, X). $memo(early[X:$free]) = "null". $memo(late[X:$free]) = "null". $priority(early[X]) = 1. $priority(late[X]) = 5.')
    turns = " ".join(s.run_agenda())
    s.execute(":- print_memo_table early/1.\n:- print_memo_table late/1.")
    kept = dict(line.split(" = ") for line in s.printed)
    return rows(spark, {"turns": turns, **{k: kept[k] for k in ("early(1)", "late(2)")}})


@query(values(("whole", "12"), ("list", "[1, 'a']"), ("map", "{'k': 2.5}"), ("term", "('pair', 2)"), ("handle", "9"), ("assert", "AssertionFailed")))
def host_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of the language as the host sees them."""
    s = Session(spark)
    s.execute('whole = 12. list = [1, "a"]. map = {"k" -> 2.5}. term = &pair(1, 2). box = { add(X) = X + 4. }.')
    term = s.query("term?")
    found = {n: s.query(f"{n}?") for n in ("whole", "list", "map")} | {"term": (term.name, len(term.args)) if isinstance(term, Term) else None, "handle": s.query("box?").add(5)}
    try:
        s.execute("assert whole = 13.")
    except AssertionFailed as e:
        found["assert"] = type(e).__name__
    return rows(spark, found)


@query(values(("define", ""), ("ask", "K = 1, value = 2|K = 2, value = 4"), ("print", "6"), ("wrong", "SyntaxProblem")))
def interactive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ruleframe import repl

    s = Session(spark)
    said = {"define": "f(1) = 2. f(2) = 4.", "ask": "f(K)?", "print": "print f(1) + f(2).", "wrong": "f(1 ="}
    answers = {k: "|".join(repl.respond(s, t)) for k, t in said.items()}
    return rows(spark, {k: a.replace("\n", "|").split(":")[0] for k, a in answers.items()})


@query(values(("term", "mine/2"), ("file", "elsewhere")))
def place_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule knows its own name, arity and file."""
    s = Session(spark)
    s.execute("mine(A, B) = $term. where = $file.", file="elsewhere")
    term = s.query("mine(1, 2)?", file="elsewhere")
    return rows(spark, {"term": f"{term.args[0]}/{term.args[1]}", "file": s.query("where?", file="elsewhere")})


@query(values(("first", "None"), ("second", "12"), ("third", "UnsafeRuleError")))
def notebook_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells share a session; an error is a result."""
    from ruleframe import notebook

    cells: dict = {}

    class Shell:
        user_ns: dict = {}

        def register_magic_function(self, f: Callable, kind: str, name: str) -> None:
            cells[kind, name] = f

    notebook.load_ipython_extension(Shell())
    run = cells["cell", "rules"]
    said = {"first": run("", "a = 5."), "second": run("", "a + 7?"), "third": run("", "any(X) max= 3. any(Y) > 2?")}
    return rows(spark, {k: str(v).split(":")[0] for k, v in said.items()})


@query("SELECT event_type, CAST(sum(event_id) AS BIGINT) s FROM events GROUP BY 1")
def incremental_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches, each taken by a new object that finds its state on disk; the second is replayed."""
    from ruleframe.streaming.incremental import IncrementalRelation

    events, path = read(spark, sf_dir, "events"), f"{shared_dir(spark)}/restart-{uuid.uuid4().hex}"
    for batch in (0, 1, 1, 2):
        state = IncrementalRelation(spark, path, ["event_type"], "event_id", "+=")
        state.apply(events.where(F.col("event_id") % 3 == batch), batch)
    return IncrementalRelation(spark, path, ["event_type"], "event_id", "+=").result().select("event_type", F.col("v").cast("bigint").alias("s"))


@query("SELECT l_suppkey s, l_returnflag f, sum(l_quantity) q FROM lineitem GROUP BY 1, 2 HAVING sum(l_quantity) > 100")
def nested_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate over values that are single already costs no second exchange."""
    s = Session(spark)
    s.register("li", read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag"], "l_quantity")
    s.execute("sum(S, F) += Q for Q = li(_, _, S, F). big(S, F) max= Q for Q = sum(S, F), Q > 100.")
    return named(s.relation("big", 2), "s", "f", "q")
