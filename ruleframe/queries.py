"""Registered queries: one or more per operator, with the SQL that says the same.

Each entry is a rule program over registered tables and the name of the functor
(or a query) whose rows are the result; columns are named as in the SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ruleframe import host_queries
from ruleframe.session import Session

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    tables: dict[str, tuple[str, list[str], str | None]]
    program: str
    result: tuple[str, int]
    columns: tuple[str, ...]
    sql: str | None
    rounded: int | None = None
    wide: bool = False

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        session = Session(spark)
        for name, (table, key, value) in self.tables.items():
            session.register(name, spark.read.parquet(f"{sf_dir}/{table}.parquet"), key, value)
        prepare(session)
        session.execute(self.program)
        df = session.relation(*self.result)
        names = [c for c in df.columns if not (c == "v" and len(self.columns) == len(df.columns) - 1)]
        df = df.select(*names).toDF(*self.columns)
        for f in df.schema:
            kind = f.dataType.simpleString()
            if kind == "double" and self.rounded is not None:
                df = df.withColumn(f.name, F.round(f.name, self.rounded))
            elif kind.startswith("decimal"):
                # Sums and products of whole numbers have 38 digits.
                df = df.withColumn(f.name, F.col(f.name).cast("string" if self.wide else "bigint"))
        return df


def prepare(session: Session) -> None:
    session.define_function("tax_band", 2, returns="bigint")(lambda x, t: int(x * t) % 7)


LI = ("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag"], "l_quantity")
PRICE = ("lineitem", ["l_orderkey", "l_suppkey", "l_discount"], "l_extendedprice")
ORD = ("orders", ["o_orderkey", "o_custkey", "o_orderstatus"], "o_totalprice")
CUST = ("customer", ["c_custkey", "c_nationkey", "c_mktsegment"], "c_acctbal")
NAT = ("nation", ["n_nationkey", "n_name", "n_regionkey"], None)
REG = ("region", ["r_regionkey", "r_name"], None)
SUPP = ("supplier", ["s_suppkey", "s_nationkey"], "s_acctbal")
PART = ("part", ["p_partkey", "p_brand", "p_size"], "p_retailprice")
EV = ("events", ["event_id", "user_id", "event_type"], "value")

ENTRIES: dict[str, Entry] = {}


def add(name: str, tables: dict, program: str, result: tuple[str, int], columns: str, sql: str | None, rounded: int | None = None, wide: bool = False) -> None:
    ENTRIES[name] = Entry(tables, program, result, tuple(columns.split()), sql, rounded, wide)


# Sources --------------------------------------------------------------------------
add("scan_facts", {}, 'f(1,"a"). f(2,"b"). f(2,"b"). f(3,"c").', ("f", 2), "k s", "SELECT CAST(k AS BIGINT) k, s FROM (VALUES (1,'a'),(2,'b'),(3,'c')) t(k,s)")
add("scan_table", {"c": CUST}, "r(K,N) = B for B = c(K,N,_).", ("r", 2), "k n bal", "SELECT c_custkey k, CAST(c_nationkey AS BIGINT) n, c_acctbal bal FROM customer")
add("range2", {}, "r(X) :- range(7, X).", ("r", 1), "x", "SELECT CAST(i AS BIGINT) x FROM generate_series(0, 6) t(i)")
add("range3", {"nat": NAT}, "r(K,X) :- nat(K,_,_), range(K, 5, X).", ("r", 2), "k x", "SELECT CAST(n_nationkey AS BIGINT) k, CAST(x AS BIGINT) x FROM (SELECT n_nationkey, unnest(generate_series(n_nationkey, 4)) x FROM nation WHERE n_nationkey < 5)")
add("range4", {"nat": NAT}, "r(K,X) :- nat(K,_,R), range(R, 20, 3, X), X > K.", ("r", 2), "k x", "SELECT CAST(n_nationkey AS BIGINT) k, CAST(x AS BIGINT) x FROM (SELECT n_nationkey, unnest(generate_series(n_regionkey, 19, 3)) x FROM nation) WHERE x > n_nationkey")
add("range_check", {"p": PART}, "n += 1 for _ = p(_,_,S), range(10, 40, 5, S).", ("n", 0), "n", "SELECT CAST(count(*) AS BIGINT) n FROM part WHERE p_size >= 10 AND p_size < 40 AND (p_size - 10) % 5 = 0")

# Filters and predicates ---------------------------------------------------------------
add("filter_lt", {"o": ORD}, "r(K) = P for P = o(K,_,_), P < 5000.", ("r", 1), "k p", "SELECT o_orderkey k, o_totalprice p FROM orders WHERE o_totalprice < 5000")
add("filter_le_ge", {"p": PART}, "r(K,S) :- _ = p(K,_,S), S <= 12, S >= 10.", ("r", 2), "k s", "SELECT p_partkey k, CAST(p_size AS BIGINT) s FROM part WHERE p_size BETWEEN 10 AND 12")
add("filter_chain", {"o": ORD}, "n += 1 for P = o(_,_,_), 1000.0 < P <= 90000.0 < 100000.0.", ("n", 0), "n", "SELECT CAST(count(*) AS BIGINT) n FROM orders WHERE o_totalprice > 1000 AND o_totalprice <= 90000")
add("filter_bool_value", {"c": CUST}, "r(K) = (B > 5000) && (S != \"BUILDING\") for B = c(K,_,S).", ("r", 1), "k b", "SELECT c_custkey k, (c_acctbal > 5000 AND c_mktsegment <> 'BUILDING') b FROM customer")
add("filter_or_not", {"c": CUST}, 'n(S) += 1 for B = c(_,N,S), (B < 0) || (N == 3), !(S == "MACHINERY").', ("n", 1), "s n", "SELECT c_mktsegment s, CAST(count(*) AS BIGINT) n FROM customer WHERE (c_acctbal < 0 OR c_nationkey = 3) AND c_mktsegment <> 'MACHINERY' GROUP BY 1")
add("filter_const_head", {"nat": NAT}, "tag(0,\"zero\"). tag(1,\"one\"). r(N,T) :- nat(_,N,R), tag(R,T).", ("r", 2), "n t", "SELECT n_name n, CASE n_regionkey WHEN 0 THEN 'zero' ELSE 'one' END t FROM nation WHERE n_regionkey IN (0, 1)")
add("project_anonymous", {"o": ORD}, "r(S) :- _ = o(_,_,S).", ("r", 1), "s", "SELECT DISTINCT o_orderstatus s FROM orders")
add("typed_argument", {"p": PART}, "r(B) += S for _ = p(_,B,S:int), S > 40.", ("r", 1), "b s", "SELECT p_brand b, CAST(sum(p_size) AS BIGINT) s FROM part WHERE p_size > 40 GROUP BY 1")
add("type_tests", {"c": CUST}, "r(K) = int(K) && float(B) && string(S) && !number(S) for B = c(K,_,S).", ("r", 1), "k b", "SELECT c_custkey k, true b FROM customer")
add("strict_equality", {"p": PART}, "n += 1 for R = p(_,_,S), R == S. n += 100.", ("n", 0), "n", "SELECT CAST(100 AS BIGINT) n")
add("user_call", {"p": PART}, "twice(X) = X * 2. r(K) = twice(S) for _ = p(K,_,S).", ("r", 1), "k d", "SELECT p_partkey k, CAST(p_size * 2 AS BIGINT) d FROM part")
add("conditional_function", {"p": PART}, 'band(S) := "small" for S < 20. band(S) := "large" for S >= 20. n(B) += 1 for _ = p(_,_,S), B = band(S).', ("n", 1), "b n", "SELECT CASE WHEN p_size < 20 THEN 'small' ELSE 'large' END b, CAST(count(*) AS BIGINT) n FROM part GROUP BY 1")

# Joins ------------------------------------------------------------------------------
add("join_equi", {"c": CUST, "n": NAT}, "r(M) += B for B = c(_,K,_), n(K,M,_).", ("r", 1), "n b", "SELECT n_name n, round(sum(c_acctbal), 2) b FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1", 2)
add("join_multiway", {"li": PRICE, "o": ORD, "c": CUST, "n": NAT}, "revenue(M) += P*(1-D) for P = li(O,_,D), _ = o(O,C,_), _ = c(C,K,_), n(K,M,_).", ("revenue", 1), "n revenue", "SELECT n_name n, round(sum(l_extendedprice*(1-l_discount)), 2) revenue FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey GROUP BY 1", 2)
add("join_theta", {"n": NAT, "s": SUPP}, "m(M) += 1 for n(K,M,_), _ = s(_,J), J < K.", ("m", 1), "n c", "SELECT n_name n, CAST(count(*) AS BIGINT) c FROM nation JOIN supplier ON s_nationkey < n_nationkey GROUP BY 1")
add("join_range", {"p": PART}, "n(X) += 1 for range(10, 20, X), _ = p(_,_,S), S >= X, S < X + 3.", ("n", 1), "x n", "SELECT CAST(x AS BIGINT) x, CAST(count(*) AS BIGINT) n FROM generate_series(10, 19) t(x) JOIN part ON p_size >= x AND p_size < x + 3 GROUP BY 1")
add("join_bounds", {"n": NAT}, "r(K,X) :- n(K,_,R), int(X), X >= R, R + 3 > X.", ("r", 2), "k x", "SELECT CAST(n_nationkey AS BIGINT) k, CAST(n_regionkey + i AS BIGINT) x FROM nation, generate_series(0, 2) t(i)")
add("join_self_product", {"li": LI}, "elem(S, L) += Q for Q = li(_,_,S,L,_). prod(A, B) += elem(A, L) * elem(B, L).", ("prod", 2), "a b v", "WITH e AS (SELECT l_suppkey s, l_linenumber l, sum(l_quantity) q FROM lineitem GROUP BY 1, 2) SELECT x.s a, y.s b, round(sum(x.q*y.q), 2) v FROM e x JOIN e y ON x.l = y.l GROUP BY 1, 2", 2)
add("join_semi", {"c": CUST, "o": ORD}, "r(K) :- _ = c(K,_,_), P = o(_,K,_), P > 400000.", ("r", 1), "k", "SELECT c_custkey k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
add("join_anti", {"c": CUST, "o": ORD}, "big(C) :- P = o(_,C,_), P > 400000. idle(C) :- _ = c(C,_,_), !is_defined(big(C)).", ("idle", 1), "k", "SELECT c_custkey k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
add("join_left_idiom", {"c": CUST, "o": ORD}, "v(C) := 0.0 for _ = c(C,_,_). top(C) max= P for P = o(_,C,_), P > 300000. v(C) := P for P = top(C).", ("v", 1), "k v", "SELECT c_custkey k, coalesce(m, 0.0) v FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) m FROM orders WHERE o_totalprice > 300000 GROUP BY 1) ON o_custkey = c_custkey")
add("join_asof_idiom", {"e": EV}, "probe(U,T) :- _ = e(T,U,\"purchase\"). last(U,T) max= S for probe(U,T), _ = e(S,U,\"view\"), S <= T.", ("last", 2), "u t s", "SELECT p.user_id u, p.event_id t, max(v.event_id) s FROM events p JOIN events v ON p.user_id = v.user_id AND v.event_id <= p.event_id WHERE p.event_type = 'purchase' AND v.event_type = 'view' GROUP BY 1, 2")
add("join_structure", {"n": NAT}, "at(K) = &place(M, R) for n(K,M,R). r(M) :- at(_) = &place(M, 2).", ("r", 1), "n", "SELECT n_name n FROM nation WHERE n_regionkey = 2")
add("join_map_key", {"n": NAT}, 'm(K) = {"name" -> M, "key" -> str(R)} for n(K,M,R). g({"name" -> X | _}) = X. r(K) = X for m(K) = {"name" -> X | _}.', ("r", 1), "k x", "SELECT CAST(n_nationkey AS BIGINT) k, n_name x FROM nation")
add("join_skip_variable", {"o": ORD, "c": CUST}, "seg(S) :- _ = c(C,_,S), _ = o(_,C,_).", ("seg", 1), "s", "SELECT DISTINCT c_mktsegment s FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")

# Aggregators --------------------------------------------------------------------------
add("agg_sum", {"p": PART}, "r(B) += S for _ = p(_,B,S).", ("r", 1), "b s", "SELECT p_brand b, CAST(sum(p_size) AS BIGINT) s FROM part GROUP BY 1")
add("agg_product", {"n": NAT}, "r(R) *= K + 1 for n(K,_,R).", ("r", 1), "r v", "SELECT CAST(n_regionkey AS BIGINT) r, CAST(product(n_nationkey + 1) AS BIGINT) v FROM nation GROUP BY 1")
add("agg_product_wide", {"n": NAT}, "r *= K + 1 for n(K,_,_), K < 25.", ("r", 0), "v", "SELECT CAST(factorial(25) AS VARCHAR) v", wide=True)
add("agg_sum_wide", {"o": ORD}, "r(S) += K * 100000000000000 for _ = o(K,_,S).", ("r", 1), "s v", "SELECT o_orderstatus s, CAST(sum(CAST(o_orderkey AS HUGEINT) * 100000000000000) AS VARCHAR) v FROM orders GROUP BY 1", wide=True)
add("agg_unique", {"n": NAT}, "r(K) = M for n(K,M,_).", ("r", 1), "k n", "SELECT CAST(n_nationkey AS BIGINT) k, n_name n FROM nation")
add("agg_max", {"o": ORD}, "r(C) max= P for P = o(_,C,_).", ("r", 1), "c p", "SELECT o_custkey c, max(o_totalprice) p FROM orders GROUP BY 1")
add("agg_min", {"o": ORD}, "r(C) min= P for P = o(_,C,_). r(C) min= 50000.0 for _ = o(_,C,_).", ("r", 1), "c p", "SELECT o_custkey c, least(min(o_totalprice), 50000.0) p FROM orders GROUP BY 1")
add("agg_exists", {"o": ORD}, 'r(C) :- _ = o(_,C,"F").', ("r", 1), "c", "SELECT DISTINCT o_custkey c FROM orders WHERE o_orderstatus = 'F'")
add("agg_or", {"o": ORD}, "r(C) |= P > 300000 for P = o(_,C,_).", ("r", 1), "c b", "SELECT o_custkey c, bool_or(o_totalprice > 300000) b FROM orders GROUP BY 1")
add("agg_and", {"o": ORD}, "r(C) &= P > 20000 for P = o(_,C,_).", ("r", 1), "c b", "SELECT o_custkey c, bool_and(o_totalprice > 20000) b FROM orders GROUP BY 1")
add("agg_override", {"c": CUST, "o": ORD}, 'big(C) :- P = o(_,C,_), P > 400000. lbl(C) := "none" for _ = c(C,_,_). lbl(C) := "big" for big(C).', ("lbl", 1), "c l", "SELECT c_custkey c, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) THEN 'big' ELSE 'none' END l FROM customer")
add("agg_override_null", {"n": NAT}, "keep(K) := R for n(K,_,R), R > 1. keep(K) := $null for n(K,_,3).", ("keep", 1), "k r", "SELECT CAST(n_nationkey AS BIGINT) k, CAST(n_regionkey AS BIGINT) r FROM nation WHERE n_regionkey > 1 AND n_regionkey <> 3")
add("agg_any", {"o": ORD}, "r(S) ?= K for _ = o(K,_,S).", ("r", 1), "s k", "SELECT o_orderstatus s, min(o_orderkey) k FROM orders GROUP BY 1")
add("agg_concat_list", {"n": NAT}, "l(R) concat_list= [M] for n(_,M,R). r(R, N) :- l(R) = L, list_length(L) = N.", ("r", 2), "r n", "SELECT CAST(n_regionkey AS BIGINT) r, CAST(count(*) AS BIGINT) n FROM nation GROUP BY 1")
add("agg_merge_map", {"n": NAT}, "m(R) merge_map= {M -> K} for n(K,M,R). r(R) = $map_keys(M) for m(R) = M.", ("r", 1), "r k", "SELECT CAST(n_regionkey AS BIGINT) r, list_sort(list(n_name)) k FROM nation GROUP BY 1")
add("agg_mean", {"c": CUST}, "r(S) mean= B for B = c(_,_,S).", ("r", 1), "s b", "SELECT c_mktsegment s, round(avg(c_acctbal), 4) b FROM customer GROUP BY 1", 4)
add("agg_count", {"li": LI}, "r(F) += 1 for _ = li(_,_,_,_,F).", ("r", 1), "f n", "SELECT l_returnflag f, CAST(count(*) AS BIGINT) n FROM lineitem GROUP BY 1")
add("agg_count_distinct", {"li": LI}, "d(F,P) :- _ = li(_,P,_,_,F). r(F) += 1 for d(F,_).", ("r", 1), "f n", "SELECT l_returnflag f, CAST(count(DISTINCT l_partkey) AS BIGINT) n FROM lineitem GROUP BY 1")
add("agg_argmax", {"o": ORD}, "top(S) max= P for P = o(K,_,S) arg K. r(S) = $arg(top(S)).", ("r", 1), "s k", "SELECT o_orderstatus s, arg_max(o_orderkey, o_totalprice) k FROM orders GROUP BY 1")
add("agg_argmin_value", {"o": ORD}, "low(S) min= P for P = o(K,_,S) with_key K. r(S) = $value(low(S)).", ("r", 1), "s p", "SELECT o_orderstatus s, min(o_totalprice) p FROM orders GROUP BY 1")
add("agg_argmax_text", {"c": CUST}, "last(N) max= S for _ = c(K,N,S) arg K. r(N,S,K) :- S = last(N), K = $arg(last(N)).", ("r", 3), "n s k", "SELECT CAST(c_nationkey AS BIGINT) n, max(c_mktsegment) s, min(c_custkey) FILTER (WHERE c_mktsegment = m) k FROM (SELECT *, max(c_mktsegment) OVER (PARTITION BY c_nationkey) m FROM customer) GROUP BY 1")
add("agg_multi_rule", {"c": CUST, "s": SUPP}, "t(N) += B for B = c(_,N,_). t(N) += B for B = s(_,N).", ("t", 1), "n b", "SELECT CAST(n AS BIGINT) n, round(sum(b), 2) b FROM (SELECT c_nationkey n, c_acctbal b FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier) GROUP BY 1", 2)
add("agg_semicolon", {"c": CUST}, "t(N) += B for B = c(_,N,_) ; 100.0 for _ = c(_,N,_).", ("t", 1), "n b", "SELECT CAST(c_nationkey AS BIGINT) n, round(sum(c_acctbal) + 100 * count(*), 2) b FROM customer GROUP BY 1", 2)
add("agg_empty_group", {"li": LI}, "n += 1 for Q = li(_,_,_,_,_), Q > 100000.0.", ("n", 0), "n", "SELECT CAST(1 AS BIGINT) n WHERE false")
add("agg_inline", {"c": CUST, "o": ORD}, "r(K) = (+= P for P = o(_,K,_)) for _ = c(K,_,_).", ("r", 1), "k p", "SELECT o_custkey k, round(sum(o_totalprice), 2) p FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) GROUP BY 1", 2)
add("agg_mixed", {"n": NAT}, "r(K) += 1 for n(K,_,0). r(K) max= 7 for n(K,_,1).", ("r", 1), "k v", "SELECT CAST(n_nationkey AS BIGINT) k, CAST(CASE n_regionkey WHEN 0 THEN 1 ELSE 7 END AS BIGINT) v FROM nation WHERE n_regionkey < 2")
add("agg_two_level", {"li": LI}, "q(S,F) += Q for Q = li(_,_,S,_,F). best(F) max= X for X = q(_,F).", ("best", 1), "f q", "SELECT f, max(q) q FROM (SELECT l_returnflag f, l_suppkey s, sum(l_quantity) q FROM lineitem GROUP BY 1, 2) GROUP BY 1")

# Sets -----------------------------------------------------------------------------------
add("set_union_bag", {"c": CUST, "s": SUPP}, "u(N) += 1 for _ = c(_,N,_). u(N) += 1 for _ = s(_,N).", ("u", 1), "n c", "SELECT CAST(n AS BIGINT) n, CAST(count(*) AS BIGINT) c FROM (SELECT c_nationkey n FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1")
add("set_union", {"c": CUST, "s": SUPP}, "u(N) :- _ = c(_,N,_). u(N) :- _ = s(_,N).", ("u", 1), "n", "SELECT CAST(c_nationkey AS BIGINT) n FROM customer UNION SELECT CAST(s_nationkey AS BIGINT) FROM supplier")
add("set_intersect", {"p": PART, "li": LI}, "a(S) :- _ = p(_,_,S). b(S) :- _ = li(_,_,_,S,_). i(S) :- a(S), b(S).", ("i", 1), "s", "SELECT CAST(p_size AS BIGINT) s FROM part INTERSECT SELECT CAST(l_linenumber AS BIGINT) FROM lineitem")
add("set_except", {"p": PART, "li": LI}, "a(S) :- _ = p(_,_,S). b(S) :- _ = li(_,_,_,S,_). x(S) :- a(S), !is_defined(b(S)).", ("x", 1), "s", "SELECT CAST(p_size AS BIGINT) s FROM part EXCEPT SELECT CAST(l_linenumber AS BIGINT) FROM lineitem")

# Window idioms ---------------------------------------------------------------------------
add("win_top1", {"s": SUPP}, "t(N) max= B for B = s(K,N) arg K. r(N,K) :- K = $arg(t(N)).", ("r", 2), "n k", "SELECT n, k FROM (SELECT CAST(s_nationkey AS BIGINT) n, s_suppkey k, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) r FROM supplier) WHERE r = 1")
add("win_rank_idiom", {"s": SUPP}, "above(K) += 1 for B = s(K,N), C = s(_,N), C > B. rank(K) := 1 for _ = s(K,_). rank(K) := above(K) + 1.", ("rank", 1), "k r", "SELECT s_suppkey k, CAST(rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) AS BIGINT) r FROM supplier")
add("win_running_sum", {"p": PART}, "q(S) += 1 for _ = p(_,_,S). run(S) += C for C = q(T), _ = q(S), T <= S.", ("run", 1), "s c", "SELECT CAST(p_size AS BIGINT) s, CAST(sum(count(*)) OVER (ORDER BY p_size) AS BIGINT) c FROM part GROUP BY p_size")
add("win_prev", {"p": PART}, "q(S) += 1 for _ = p(_,_,S). d(S) = q(S) - q(S-1).", ("d", 1), "s d", "WITH q AS (SELECT CAST(p_size AS BIGINT) s, count(*) c FROM part GROUP BY 1) SELECT a.s, CAST(a.c - b.c AS BIGINT) d FROM q a JOIN q b ON b.s = a.s - 1")

# Scalar functions ----------------------------------------------------------------------------
add("fn_add_inverse", {"p": PART}, "r(K,X,Y) :- _ = p(K,_,S), S = X + 3, 100 = S + Y.", ("r", 3), "k x y", "SELECT p_partkey k, CAST(p_size - 3 AS BIGINT) x, CAST(100 - p_size AS BIGINT) y FROM part")
add("fn_sub_neg", {"p": PART}, "r(K,X,Y) :- _ = p(K,_,S), X = 10 - S, S = -Y.", ("r", 3), "k x y", "SELECT p_partkey k, CAST(10 - p_size AS BIGINT) x, CAST(-p_size AS BIGINT) y FROM part")
add("fn_mul_inverse", {"p": PART}, "r(K,X) :- R = p(K,_,_), R = X * 4.0.", ("r", 2), "k x", "SELECT p_partkey k, round(p_retailprice / 4.0, 6) x FROM part", 6)
add("fn_divide", {"li": PRICE}, "r(O,S) max= P / (D * 100.0) for P = li(O,S,D).", ("r", 2), "o s x", "SELECT l_orderkey o, l_suppkey s, max(l_extendedprice / nullif(l_discount * 100.0, 0)) x FROM lineitem WHERE l_discount <> 0 GROUP BY 1, 2")
add("fn_minmax", {"p": PART}, "r(K,A,B) :- _ = p(K,_,S), A = min(S, 25), B = max(S, 25).", ("r", 3), "k a b", "SELECT p_partkey k, CAST(least(p_size, 25) AS BIGINT) a, CAST(greatest(p_size, 25) AS BIGINT) b FROM part")
add("fn_pow_sqrt", {"p": PART}, "r(K,A,B,C) :- _ = p(K,_,S), A = S ** 2, B = sqrt(S), 64.0 = pow(C, 3).", ("r", 4), "k a b c", "SELECT p_partkey k, CAST(p_size * p_size AS DOUBLE) a, round(sqrt(p_size), 6) b, CAST(4 AS DOUBLE) c FROM part", 6)
add("fn_exp_log", {"p": PART}, "r(K,A,B) :- _ = p(K,_,S), A = log(S), exp(B) = S + 0.0.", ("r", 3), "k a b", "SELECT p_partkey k, round(ln(p_size), 6) a, round(ln(p_size), 6) b FROM part", 6)
add("fn_trig", {"p": PART}, "r(K,A,B,C,D) :- _ = p(K,_,S), A = sin(S), B = cos(S), C = tan(S), sin(D) = S / 100.0.", ("r", 5), "k a b c d", "SELECT p_partkey k, round(sin(p_size), 6) a, round(cos(p_size), 6) b, round(tan(p_size), 6) c, round(asin(p_size / 100.0), 6) d FROM part", 6)
add("fn_hyper", {"p": PART}, "r(K,A,B) :- _ = p(K,_,S), A = tanh(S / 10.0), B = sinh(S / 10.0) - cosh(S / 10.0).", ("r", 3), "k a b", "SELECT p_partkey k, round(tanh(p_size / 10.0), 6) a, round(sinh(p_size / 10.0) - cosh(p_size / 10.0), 6) b FROM part", 6)
add("fn_inv_hyper", {"p": PART}, "r(K,A,B,C) :- _ = p(K,_,S), A = asinh(S), B = acosh(S + 1), C = atanh(S / 100.0).", ("r", 4), "k a b c", "SELECT p_partkey k, round(asinh(p_size), 6) a, round(acosh(p_size + 1), 6) b, round(atanh(p_size / 100.0), 6) c FROM part", 6)
add("fn_str", {"n": NAT}, 'r(K) = str(M, "/", R, "!") for n(K,M,R).', ("r", 1), "k s", "SELECT CAST(n_nationkey AS BIGINT) k, n_name || '/' || n_regionkey || '!' s FROM nation")
add("fn_cast", {"p": PART}, "r(K,A,B) :- R = p(K,_,S), A = cast_int(R), B = cast_float(S).", ("r", 3), "k a b", "SELECT p_partkey k, CAST(floor(p_retailprice) AS BIGINT) a, CAST(p_size AS DOUBLE) b FROM part")
add("fn_regex", {"n": NAT}, 'r(K,D) :- n(K,M,_), $regex_match("[0-9]", M) = [D].', ("r", 2), "k d", "SELECT DISTINCT CAST(n_nationkey AS BIGINT) k, unnest(regexp_extract_all(n_name, '[0-9]')) d FROM nation")
add("fn_regex_groups", {"n": NAT}, 'r(K,A,D) :- n(K,M,_), $regex_match("([A-Z])([0-9]|_)", M) = [A,D].', ("r", 3), "k a d", "SELECT DISTINCT CAST(k AS BIGINT) k, m[1] a, m[2] d FROM (SELECT n_nationkey k, unnest(regexp_extract_all(n_name, '[A-Z][0-9_]')) m FROM nation)")
add("fn_random", {"n": NAT}, "r(K) = random(K, 5, 9) for n(K,_,_).", ("r", 1), "k x", "SELECT CAST(n_nationkey AS BIGINT) k, round(5 + 4 * (CAST('0x' || substr(md5('0:' || n_nationkey), 1, 13) AS BIGINT) / 4503599627370496.0), 6) x FROM nation", 6)
add("fn_is_defined", {"c": CUST, "o": ORD}, "big(C) :- P = o(_,C,_), P > 450000. r(C) = is_defined(big(C)) for _ = c(C,_,_).", ("r", 1), "c b", "SELECT c_custkey c, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000) b FROM customer")
add("list_build", {"n": NAT}, "r(K) = [M, \"x\" | []] for n(K,M,_).", ("r", 1), "k l", "SELECT CAST(n_nationkey AS BIGINT) k, [n_name, 'x'] l FROM nation")
add("list_destructure", {"n": NAT}, "l(K) = [K, R, 7] for n(K,_,R). r(K,A,N) :- l(K) = [A | T], list_length(T) = N.", ("r", 3), "k a n", "SELECT CAST(n_nationkey AS BIGINT) k, CAST(n_nationkey AS BIGINT) a, CAST(2 AS BIGINT) n FROM nation")
add("list_length", {"n": NAT}, "l(R) concat_list= [K, K] for n(K,_,R). r(R) = list_length(l(R)).", ("r", 1), "r n", "SELECT CAST(n_regionkey AS BIGINT) r, CAST(2 * count(*) AS BIGINT) n FROM nation GROUP BY 1")
add("list_member", {"n": NAT}, "l(R) concat_list= [K] for n(K,_,R). r(R,X) :- l(R) = L, in_list(X, L).", ("r", 2), "r x", "SELECT CAST(n_regionkey AS BIGINT) r, CAST(n_nationkey AS BIGINT) x FROM nation")
add("map_get", {"n": NAT}, 'm(K) = {"a" -> K, "b" -> R} for n(K,_,R). r(K) = X for m(K) = {"b" -> X | _}.', ("r", 1), "k x", "SELECT CAST(n_nationkey AS BIGINT) k, CAST(n_regionkey AS BIGINT) x FROM nation")
add("map_put", {"n": NAT}, 'm(K) = {"a" -> K} for n(K,_,_). p(K) = {"b" -> 5 | M} for m(K) = M. r(K,X) :- p(K) = {"b" -> X | _}.', ("r", 2), "k x", "SELECT CAST(n_nationkey AS BIGINT) k, CAST(5 AS BIGINT) x FROM nation")
add("map_element", {"n": NAT}, 'm(K) = {"a" -> K, "b" -> R} for n(K,_,R). r(K,Y,V) :- M = m(K), $map_element(Y, V, _, M).', ("r", 3), "k y v", "SELECT CAST(n_nationkey AS BIGINT) k, 'a' y, CAST(n_nationkey AS BIGINT) v FROM nation UNION ALL SELECT CAST(n_nationkey AS BIGINT), 'b', CAST(n_regionkey AS BIGINT) FROM nation")
add("map_keys_values", {"n": NAT}, 'm(K) = {"b" -> K, "a" -> R} for n(K,_,R). r(K,A,B) :- M = m(K), A = $map_keys(M), B = $map_values(M).', ("r", 3), "k a b", "SELECT CAST(n_nationkey AS BIGINT) k, ['a', 'b'] a, [CAST(n_regionkey AS BIGINT), CAST(n_nationkey AS BIGINT)] b FROM nation")
add("struct_match", {"n": NAT}, "s(K) = &node(M, &leaf(R)) for n(K,M,R). r(K,M) :- s(K) = &node(M, &leaf(1)).", ("r", 2), "k n", "SELECT CAST(n_nationkey AS BIGINT) k, n_name n FROM nation WHERE n_regionkey = 1")

# Recursion and memoisation --------------------------------------------------------------------
add("rec_reach", {"n": NAT}, "e(X,Y) :- n(X,_,R), n(Y,_,R), Y = X + 5. reach(X,Y) :- e(X,Y). reach(X,Z) :- reach(X,Y), e(Y,Z).", ("reach", 2), "x y", "WITH RECURSIVE e AS (SELECT a.n_nationkey x, b.n_nationkey y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND b.n_nationkey = a.n_nationkey + 5), r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y) SELECT CAST(x AS BIGINT) x, CAST(y AS BIGINT) y FROM r")
add("rec_shortest_path", {"n": NAT}, "e(X,Y) = R + 1 for n(X,_,R), Y = X + 1, Y < 25. e(X,Y) = R * 3 + 2 for n(X,_,R), Y = X + 3, Y < 25. dist(0) min= 0. dist(Y) min= dist(X) + e(X,Y).", ("dist", 1), "n d", "WITH RECURSIVE e AS (SELECT n_nationkey x, n_nationkey + 1 y, n_regionkey + 1 w FROM nation WHERE n_nationkey < 24 UNION ALL SELECT n_nationkey, n_nationkey + 3, n_regionkey * 3 + 2 FROM nation WHERE n_nationkey < 22), p AS (SELECT 0 n, 0 d UNION SELECT e.y, p.d + e.w FROM p JOIN e ON e.x = p.n) SELECT CAST(n AS BIGINT) n, CAST(min(d) AS BIGINT) d FROM p GROUP BY 1")
add("rec_path_counts", {"n": NAT}, "paths(0) += 1. paths(Y) += paths(X) for n(X,_,_), Y = X + 1, Y < 25. paths(Y) += paths(X) for n(X,_,_), Y = X + 2, Y < 25.", ("paths", 1), "n c", "WITH RECURSIVE p AS (SELECT 0 n UNION ALL SELECT p.n + s FROM p, (VALUES (1), (2)) t(s) WHERE p.n + s < 25) SELECT CAST(n AS BIGINT) n, CAST(count(*) AS BIGINT) c FROM p GROUP BY 1")
add("rec_fib", {}, 'fib(0) := 0. fib(1) := 1. fib(N) := fib(N-1) + fib(N-2) for N > 1. $memo(fib[N:$ground]) = "unk". r(N) = str(fib(N)) for range(0, 91, N).', ("r", 1), "n f", "WITH RECURSIVE f AS (SELECT 0 n, CAST(0 AS HUGEINT) a, CAST(1 AS HUGEINT) b UNION ALL SELECT n + 1, b, a + b FROM f WHERE n < 90) SELECT CAST(n AS BIGINT) n, CAST(a AS VARCHAR) f FROM f")
add("rec_fact", {"p": PART}, "fact(0) = 1. fact(N) = N * fact(N-1) for N > 0. size(S) :- _ = p(_,_,S), S <= 20. r(S) = fact(S) for size(S).", ("r", 1), "s f", "SELECT DISTINCT CAST(p_size AS BIGINT) s, CAST(factorial(p_size) AS BIGINT) f FROM part WHERE p_size <= 20")
add("rec_edit_distance", {}, 'd([],[]) min= 0. d([X|A],B) min= 1 + d(A,B). d(A,[Y|B]) min= 1 + d(A,B). d([X|A],[Y|B]) min= d(A,B) for X == Y. d([X|A],[Y|B]) min= 1 + d(A,B) for X != Y. w(1,["k","i","t","t","e","n"]). w(2,["s","i","t","t","i","n","g"]). w(3,["s","u","n"]). r(I,J) = d(A,B) for w(I,A), w(J,B).', ("r", 2), "i j d", "SELECT CAST(a.i AS BIGINT) i, CAST(b.i AS BIGINT) j, levenshtein(a.s, b.s) d FROM (VALUES (1,'kitten'),(2,'sitting'),(3,'sun')) a(i,s), (VALUES (1,'kitten'),(2,'sitting'),(3,'sun')) b(i,s)")
add("rec_viterbi", {}, 'seen(0)="walk". seen(1)="shop". seen(2)="clean". start("rain")=0.5. start("sun")=0.5. turn("rain","rain")=0.75. turn("rain","sun")=0.25. turn("sun","rain")=0.5. turn("sun","sun")=0.5. does("rain","walk")=0.125. does("rain","shop")=0.5. does("rain","clean")=0.375. does("sun","walk")=0.5. does("sun","shop")=0.25. does("sun","clean")=0.25. path(0,S) max= start(S)*does(S,seen(0)) arg [S]. path(I,T) max= path(I-1,S)*turn(S,T)*does(T,seen(I)) for range(1,3,I) arg [T|$arg(path(I-1,S))]. $memo(path[I:$free,S:$free]) = "null". r(S) = P for P = $value(path(2,S)).', ("r", 1), "s p", "WITH RECURSIVE turns(a, b, p) AS (VALUES ('rain','rain',0.75),('rain','sun',0.25),('sun','rain',0.5),('sun','sun',0.5)), does(s, o, p) AS (VALUES ('rain','walk',0.125),('rain','shop',0.5),('rain','clean',0.375),('sun','walk',0.5),('sun','shop',0.25),('sun','clean',0.25)), seen(i, o) AS (VALUES (0,'walk'),(1,'shop'),(2,'clean')), paths AS (SELECT 0 i, s, CAST(0.5 * p AS DOUBLE) p FROM does WHERE o = 'walk' UNION ALL SELECT q.i + 1, b, CAST(q.p * t.p * d.p AS DOUBLE) FROM paths q JOIN turns t ON t.a = q.s JOIN seen n ON n.i = q.i + 1 JOIN does d ON d.s = t.b AND d.o = n.o) SELECT s, max(p) p FROM paths WHERE i = 2 GROUP BY s")
add("memo_null", {"o": ORD}, 'spent(C) += P for P = o(_,C,_). $memo(spent[C:$free]) = "null". top max= spent(_). n += 1 for X = spent(_), X > 1000000. r(1) = top. r(2) = n * 1.0.', ("r", 1), "k v", "WITH s AS (SELECT sum(o_totalprice) p FROM orders GROUP BY o_custkey) SELECT CAST(1 AS BIGINT) k, round(max(p), 2) v FROM s UNION ALL SELECT 2, CAST(count(*) AS DOUBLE) FROM s WHERE p > 1000000 HAVING count(*) > 0", 2)
add("memo_unk", {"p": PART}, 'stairs(N) := 1 for N < 1. stairs(N) := stairs(N-1) + stairs(N-3) for N >= 1. $memo(stairs[N:$ground]) = "unk". $priority(stairs[N]) = N. r(S) = stairs(S) for _ = p(_,_,S).', ("r", 1), "s v", "WITH RECURSIVE f AS (SELECT 0 n, CAST(1 AS BIGINT) a, CAST(1 AS BIGINT) b, CAST(1 AS BIGINT) c UNION ALL SELECT n + 1, a + c, a, b FROM f WHERE n < 60) SELECT DISTINCT CAST(p_size AS BIGINT) s, a v FROM part JOIN f ON n = p_size")

# Objects, macros, higher order -------------------------------------------------------------------
add("obj_frame_method", {"li": LI}, "shop = { qty(S) += Q for Q = li(_,_,S,_,_). best max= Q for Q = $self.qty(_). }. r(S) = Q for Q = shop.qty(S).", ("r", 1), "s q", "SELECT l_suppkey s, sum(l_quantity) q FROM lineitem GROUP BY 1")
add("obj_inherit", {"n": NAT}, "a = { z += K for n(K,_,0). }. b = new a { z += K for n(K,_,1). }. r(1) = a.z. r(2) = b.z.", ("r", 1), "k z", "SELECT CAST(1 AS BIGINT) k, CAST(sum(n_nationkey) AS BIGINT) z FROM nation WHERE n_regionkey = 0 UNION ALL SELECT 2, CAST(sum(n_nationkey) AS BIGINT) FROM nation WHERE n_regionkey < 2")
add("obj_method_chain", {}, "rect(W,H) = { area = W * H. side(N) = rect(W * N, H + N). }. box(1) = rect(3,4). box(2) = rect(3,4).side(2). box(3) = box(2).side(3). r(N) = box(N).area.", ("r", 1), "n a", "SELECT CAST(n AS BIGINT) n, CAST(a AS BIGINT) a FROM (VALUES (1, 12), (2, 36), (3, 162)) t(n, a)")
add("call_indirect", {"n": NAT}, "plus(A,B) = A + B. r(K) = V for n(K,_,R), F = &plus(100), V = F(R).", ("r", 1), "k v", "SELECT CAST(n_nationkey AS BIGINT) k, CAST(100 + n_regionkey AS BIGINT) v FROM nation")
add("macro_expand", {"n": NAT}, ":- macro twice/1.\ntwice(X) = `(`X + `X). r(K) = twice(R + 1) for n(K,_,R).", ("r", 1), "k v", "SELECT CAST(n_nationkey AS BIGINT) k, CAST(2 * (n_regionkey + 1) AS BIGINT) v FROM nation")
add("reflect_term", {}, 'gear(1) = &wheel(20, "steel", 3). gear(2) = &belt(90). r(K, N, A) :- $reflect(gear(K), N, A, _).', ("r", 3), "k n a", "SELECT CAST(k AS BIGINT) k, n, CAST(a AS BIGINT) a FROM (VALUES (1,'wheel',3),(2,'belt',1)) t(k,n,a)")
add("higher_order_fold", {}, "fold(F, Z, []) = Z. fold(F, Z, [X | R]) = F(X, fold(F, Z, R)). r(1) = fold(((A, B) += A * 2 + B), 0, [3, 4, 5]). r(2) = fold(((A, B) max= A ; B), 0, [3, 9, 5]).", ("r", 1), "i v", "SELECT CAST(i AS BIGINT) i, CAST(v AS BIGINT) v FROM (VALUES (1, 24), (2, 9)) t(i, v)")
add("dispose_quote", {}, ":- dispose logged(&,*).\nlogged(What, When) = &entry(What, When). r(N, T) :- logged(door(7), 3 + 5) = &entry(&door(N), T).", ("r", 2), "n t", "SELECT CAST(7 AS BIGINT) n, CAST(8 AS BIGINT) t")
add("udf_python", {"s": SUPP}, "r(K) = tax_band(B, 3) for B = s(K,_), B > 0.", ("r", 1), "k t", "SELECT s_suppkey k, CAST(CAST(floor(s_acctbal * 3) AS BIGINT) % 7 AS BIGINT) t FROM supplier WHERE s_acctbal > 0")


def incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums kept up to date over two batches of events."""
    import uuid

    from ruleframe.plans.fixpoint import shared_dir
    from ruleframe.streaming.incremental import IncrementalRelation

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    state = IncrementalRelation(spark, f"{shared_dir(spark)}/incremental-{uuid.uuid4().hex}", ["event_type"], "event_id", "+=")
    state.apply(events.where("event_id % 2 = 0"))
    state.apply(events.where("event_id % 2 = 1"))
    return state.result().select("event_type", F.col("v").cast("bigint").alias("s"))


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relation written as CSV and imported as facts of strings."""
    import uuid

    from ruleframe.plans.fixpoint import shared_dir
    from ruleframe.sources.csvio import export_csv, import_csv

    session = Session(spark)
    session.register("n", spark.read.parquet(f"{sf_dir}/nation.parquet"), ["n_nationkey", "n_name"])
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    export_csv(session, "n", 2, path)
    import_csv(session, "back", 3, path)
    session.execute("r(K, M) :- back(K, M, _).")
    return session.relation("r", 2).select(F.col("a0").alias("k"), F.col("a1").alias("m"))


QUERIES: dict[str, Query] = {name: e.run for name, e in ENTRIES.items()} | {"memo_incremental": incremental, "csv_roundtrip": csv_roundtrip} | host_queries.QUERIES
ORACLE_SQL: dict[str, str] = {name: e.sql for name, e in ENTRIES.items() if e.sql} | {
    "memo_incremental": "SELECT event_type, CAST(sum(event_id) AS BIGINT) s FROM events GROUP BY 1",
    "csv_roundtrip": "SELECT CAST(n_nationkey AS VARCHAR) k, n_name m FROM nation",
} | host_queries.ORACLE_SQL
