"""Rules over DataFrames: bodies become joins, filters and projections.

A functor is a DataFrame with columns ``a0 .. an-1`` (the arguments), ``v`` (the
value) and, where the rule names a witness, ``k``.  Catalyst orders the joins,
prunes columns and pushes filters; this module only says what is joined.
Recursive functors are computed by :mod:`ruleframe.plans.fixpoint`.
"""

from __future__ import annotations

import itertools
import re
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DecimalType, DoubleType, FloatType, IntegralType, MapType, NumericType, StringType, StructType

from ruleframe.functions.columns import MODES, TESTS, hash_unit
from ruleframe.functions.scalar import BUILTINS, FREE
from ruleframe.operators.aggregators import AGGREGATORS
from ruleframe.plans.rules import Goal, Part, Rule, V, variables
from ruleframe.plans.terms import NIL, NULL, FrozenMap, Handle, Keyed, RuleError, Term, UnsafeRuleError, is_list, uncons

#: Largest number of distinct arguments that a recursive function over values may be asked for.
DEMAND_ROWS = 10_000
TYPES = ("int", "float", "number", "string", "bool")
_count = itertools.count()


def literal(x: Any) -> Column:
    """A value of the language as a column."""
    if isinstance(x, Keyed):
        x = x.value
    if is_list(x):
        return F.array(*map(literal, uncons(x)))
    if isinstance(x, Term):
        return F.struct(F.lit(x.name).alias("functor"), *(literal(a).alias(f"x{i}") for i, a in enumerate(x.args)))
    if isinstance(x, FrozenMap):
        return F.create_map(*(c for k, v in x.items() for c in (literal(k), literal(v))))
    if isinstance(x, int) and not isinstance(x, bool):
        return F.lit(x).cast("bigint") if -(1 << 63) <= x < 1 << 63 else F.lit(str(x)).cast("decimal(38,0)")
    return F.lit(x)


def widened(df: DataFrame) -> DataFrame:
    """Whole numbers as 64 bits, so that equal keys of two tables meet."""
    return df.select(*(F.col(f"`{f.name}`").cast("bigint").alias(f.name) if isinstance(f.dataType, IntegralType) else F.col(f"`{f.name}`") for f in df.schema))


def whole(t: DataType) -> bool:
    """Whole numbers: 64 bits, or the 38 digits of sums and products."""
    return isinstance(t, IntegralType) or isinstance(t, DecimalType) and t.scale == 0


def comparable(a: DataType, b: DataType, constant: bool) -> bool:
    """Whether values of two column types can be equal; constants take the
    numeric type of the column they meet."""
    if isinstance(a, NumericType) and isinstance(b, NumericType):
        return constant or whole(a) == whole(b)
    return type(a) is type(b)


class Body:
    """A conjunction under construction: a DataFrame and what its variables are."""

    def __init__(self, compiler: Compiler, df: DataFrame | None = None, columns: dict[str, str] | None = None, constants: dict[str, Any] | None = None):
        self.c = compiler
        self.df = df
        self.columns: dict[str, str] = dict(columns or {})
        self.constants: dict[str, Any] = dict(constants or {})

    @property
    def frame(self) -> DataFrame:
        if self.df is None:
            self.df = self.c.spark.range(1).select()
        return self.df

    def known(self, x: Any) -> bool:
        return all(n in self.columns or n in self.constants for n in variables(x))

    def column(self, x: Any) -> Column:
        if isinstance(x, V):
            return F.col(self.columns[x.name]) if x.name in self.columns else literal(self.constants[x.name])
        if isinstance(x, Term) and x.name == "." and not is_list(x):
            return F.concat(F.array(self.column(x.args[0])), self.column(x.args[1]))
        if isinstance(x, Term) and x.args and variables(x):
            if is_list(x):
                return F.array(*map(self.column, uncons(x)))
            return F.struct(F.lit(x.name).alias("functor"), *(self.column(a).alias(f"x{i}") for i, a in enumerate(x.args)))
        return literal(x)

    def value(self, x: Any) -> Any:
        """Plan-time value, or None."""
        if isinstance(x, V):
            return self.constants.get(x.name)
        return None if variables(x) else x

    def is_constant(self, x: Any) -> bool:
        return not any(n in self.columns for n in variables(x))

    def type_of(self, c: Column) -> DataType:
        return self.frame.select(c.alias("t")).schema[0].dataType

    def where(self, condition: Column) -> None:
        self.df = self.frame.where(condition)

    def bind(self, name: str, c: Column, check: bool = True) -> None:
        at = f"x{next(_count)}"
        self.df = self.frame.withColumn(at, c)
        if check and self.df.schema[at].nullable:
            self.df = self.df.where(F.col(at).isNotNull())
        self.columns[name] = at

    def match(self, pattern: Any, c: Column) -> None:
        """Unify a template with a column."""
        if isinstance(pattern, V) and pattern.name not in self.columns and pattern.name not in self.constants:
            self.bind(pattern.name, c)
        elif isinstance(pattern, Term) and pattern.name == "." and not (is_list(pattern) and not variables(pattern)):
            self.where(F.size(c) > 0)
            self.match(pattern.args[0], F.element_at(c, 1))
            self.match(pattern.args[1], F.slice(c, 2, F.size(c)))
        elif pattern == NIL:
            self.where(F.size(c) == 0)
        elif isinstance(pattern, Term) and pattern.args and not is_list(pattern):
            kind = self.type_of(c)
            if not isinstance(kind, StructType) or "functor" not in kind.names or len(kind.names) != len(pattern.args) + 1:
                self.where(F.lit(False))
                for n in variables(pattern):
                    if n not in self.columns and n not in self.constants:
                        self.bind(n, F.lit(None).cast("string"), check=False)
                return
            self.where(c["functor"] == pattern.name)
            for i, a in enumerate(pattern.args):
                self.match(a, c[f"x{i}"])
        else:
            self.same(self.column(pattern), c, self.is_constant(pattern))

    def same(self, a: Column, b: Column, constant: bool = False) -> None:
        if comparable(self.type_of(a), self.type_of(b), constant):
            self.where(a == b)
        else:
            self.where(F.lit(False))

    # Goals ------------------------------------------------------------------

    def run(self, goals: list[Goal], override: dict[int, DataFrame] | None = None) -> Body:
        todo = list(goals)
        while todo:
            at = next((i for i, g in enumerate(todo) if self.scalar(g, todo)), None)
            if at is None:
                at = self.relational(todo, override or {})
            if at is None and self.bounded(todo):
                continue
            if at is None:
                free = sorted({n for g in todo for n in variables(g) if "#" not in n and n not in self.columns and n not in self.constants})
                raise UnsafeRuleError(f"not enough is known of {', '.join(free) or 'an expression'} to evaluate {todo[0].name or todo[0].kind}")
            todo.pop(at)
        return self

    def scalar(self, g: Goal, todo: list[Goal]) -> bool:
        """Do a goal that needs no further relation, if its arguments are known."""
        if g.kind == "unify":
            a, b = g.args
            if self.known(a):
                if self.value(a) is not None and isinstance(b, V) and b.name not in self.columns and b.name not in self.constants:
                    self.constants[b.name] = self.value(a)
                else:
                    self.match(b, self.column(a))
                return True
            if self.known(b):
                if self.value(b) is not None and isinstance(a, V):
                    self.constants[a.name] = self.value(b)
                else:
                    self.match(a, self.column(b))
                return True
            return False
        if g.kind == "map":
            return self.map_goal(g)
        if g.kind in ("lambda", "object", "method") or g.kind == "call" and self.c.is_plan_value(g, self):
            return self.c.plan_value(g, self)
        if g.kind == "apply":
            f = self.value(g.args[0]) if isinstance(g.args[0], V) else g.args[0]
            if isinstance(f, Term):
                arity = len(f.args) + len(g.args) - 1
                if self.c.session.functor(f.name, arity, self.c.file) is None and self.c.session.functor(f.name, arity, "main") is not None:
                    # A name that came from the program into a library.
                    self.join(self.c.relation(self.c.session.functor(f.name, arity, "main")), (*f.args, *g.args[1:]), g.out)
                    return True
                g2 = Goal("call", (*f.args, *g.args[1:]), g.out, f.name)
                todo.append(g2)
                return True
            return False
        if g.kind == "inline" and g.data[0] == "|=" and self.known(g.data) and all(map(is_type_test, g.data[1])):
            # One type or another: columns have one type, so this is known now.
            tests = [p.goals[0] for p in g.data[1]]
            self.match_result(g.out, F.lit(any(has_type(self.type_of(self.column(t.args[0])), t.name) for t in tests)))
            return True
        if g.kind != "call":
            return False
        return self.builtin(g)

    def builtin(self, g: Goal) -> bool:
        name, args = g.name, g.args
        if name in TESTS and len(args) == 2:
            if not self.known(args):
                return name == "==" and g.out is True and self.scalar(Goal("unify", args), [])
            a, b = map(self.column, args)
            if name in ("==", "!=") and not comparable(self.type_of(a), self.type_of(b), self.is_constant(args[0]) or self.is_constant(args[1])):
                test = F.lit(name == "!=")
            else:
                test = TESTS[name](a, b)
            self.match_result(g.out, test)
            return True
        if not args and (name == "$null" or name in TYPES):
            return self.scalar(Goal("unify", (NULL if name == "$null" else Term(name), g.out)), [])
        if name == "range" and len(args) in (2, 3, 4):
            return self.range(g)
        if name in (*TYPES, "map", "list") and len(args) == 1:
            if not self.known(args):
                return False
            self.match_result(g.out, F.lit(has_type(self.type_of(self.column(args[0])), name)))
            return True
        if name == "list" and len(args) == 2 and self.known(args):
            kind = self.type_of(self.column(args[1]))
            inner = self.value(args[0]).name if isinstance(self.value(args[0]), Term) else ""
            self.match_result(g.out, F.lit(isinstance(kind, ArrayType) and has_type(kind.elementType, inner)))
            return True
        if name == "in_list" and len(args) == 2 and self.known(args[1]):
            c = self.column(args[1])
            if self.known(args[0]):
                self.match_result(g.out, F.array_contains(c, self.column(args[0])))
            else:
                at = f"x{next(_count)}"
                self.df = self.frame.withColumn(at, F.explode(c))
                self.match(args[0], F.col(at))
                self.match_result(g.out, F.lit(True))
            return True
        if name in ("$ground", "$free") and len(args) == 1 and self.known(args[0]):
            self.match_result(g.out, F.lit(name == "$ground"))
            return True
        if name == "$regex_match" and len(args) == 2 and self.known(args):
            self.regex(g)
            return True
        if name == "random" and len(args) in (1, 3) and self.known(args):
            unit = hash_unit(self.column(args[0]), self.c.session.seed)
            lo, hi = map(self.column, args[1:]) if len(args) == 3 else (F.lit(0.0), F.lit(1.0))
            self.match_result(g.out, lo + (hi - lo) * unit)
            return True
        if name == "$map_element" and len(args) == 4 and self.known(args[3]):
            m = self.column(args[3])
            if not self.known(args[0]):
                at = f"x{next(_count)}"
                self.df = self.frame.withColumn(at, F.explode(F.map_keys(m)))
                self.match(args[0], F.col(at))
            k = self.column(args[0])
            self.where(F.map_contains_key(m, k))
            self.match(args[1], F.element_at(m, k))
            self.match(args[2], F.map_filter(m, lambda key, _: key != k))
            self.match_result(g.out, F.lit(True))
            return True
        if name == "$arg" and len(args) == 1 and isinstance(args[0], V) and f"{args[0].name}$key" in self.columns:
            self.match_result(g.out, F.col(self.columns[f"{args[0].name}$key"]))
            return True
        host = self.c.session.functions.get((name, len(args)))
        if host is not None and all(not variables(a) or isinstance(a, V) and a.name in self.constants for a in args):
            found = list(host(*map(self.value, args), FREE) or ())
            if len(found) > 1:
                return False
            return self.scalar(Goal("unify", (found[0][-1], g.out)), []) if found else self.scalar(Goal("unify", (True, False)), [])
        udf = self.c.session.udfs.get((name, len(args)))
        if udf is not None:
            if not self.known(args):
                return False
            self.match_result(g.out, udf(*map(self.column, args)))
            return True
        for known, solved, build in MODES.get((name, len(args)), ()):
            places = (*args, g.out)
            if all(self.known(places[i]) for i in known):
                cells = [self.column(places[i]) for i in known]
                if name == "*" and solved == 2 and all(whole(self.type_of(c)) for c in cells):
                    # The product of two 64-bit numbers has up to 38 digits.
                    cells = [c.cast("decimal(38,0)") for c in cells]
                self.match_result(places[solved], build(*cells))
                if name == "list_length" and len(args) == 2:
                    self.match_result(g.out, F.lit(True))
                return True
        return False

    def regex(self, g: Goal) -> None:
        """A row for each match: the list of its groups, or of the match if there are none."""
        pattern, text = g.args
        known = self.value(pattern)
        groups = re.compile(known).groups if isinstance(known, str) else 0
        each = [F.regexp_extract_all(self.column(text), self.column(pattern), F.lit(i)) for i in range(1, groups + 1) or (0,)]
        names = [f"g{i}" for i in range(len(each))]
        at = f"x{next(_count)}"
        self.df = self.frame.withColumn(at, F.explode(F.arrays_zip(*(c.alias(n) for c, n in zip(each, names, strict=True)))))
        cells = [F.col(at)[i] for i in self.frame.schema[at].dataType.names]
        self.match_result(g.out, F.array(*cells))

    def bounded(self, todo: list[Goal]) -> bool:
        """``int(X)`` between known bounds lists whole numbers; the bounds stay as filters."""
        flip = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}
        for g in todo:
            if g.kind != "call" or g.name != "int" or g.out is not True or not isinstance(g.args[0], V) or self.known(g.args[0]):
                continue
            lows, highs = [], []
            for b in todo:
                if b.kind == "call" and b.name in flip and b.out is True:
                    left, right, op = *b.args, b.name
                    if right == g.args[0]:
                        left, right, op = right, left, flip[op]
                    if left == g.args[0] and self.known(right):
                        (lows if op in (">", ">=") else highs).append(self.column(right))
            if lows and highs:
                lo = F.ceil(F.greatest(*lows) if len(lows) > 1 else lows[0]).cast("bigint")
                hi = F.floor(F.least(*highs) if len(highs) > 1 else highs[0]).cast("bigint")
                at = f"x{next(_count)}"
                self.df = self.frame.withColumn(at, F.explode(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))))
                self.columns[g.args[0].name] = at
                return True
        return False

    def match_result(self, out: Any, c: Column) -> None:
        if out is True and isinstance(self.type_of(c), BooleanType):
            self.where(c)
        else:
            self.match(out, c)

    def range(self, g: Goal) -> bool:
        *bounds, x = g.args
        lo, hi, step = (0, *bounds, 1) if len(bounds) == 1 else (*bounds, 1) if len(bounds) == 2 else bounds
        if not self.known((lo, hi, step)):
            return False
        a, b, s = (self.column(e).cast("bigint") for e in (lo, hi, step))
        if self.known(x):
            c = self.column(x)
            inside = ((s > 0) & (c >= a) & (c < b) | (s < 0) & (c <= a) & (c > b)) & ((c - a) % s == 0) if whole(self.type_of(c)) else F.lit(False)
            self.match_result(g.out, inside)
            return True
        at = f"x{next(_count)}"
        last = F.when(s > 0, b - 1).otherwise(b + 1)
        filled = F.when((s > 0) & (a < b) | (s < 0) & (a > b), F.sequence(a, last, s)).otherwise(F.array().cast("array<bigint>"))
        self.df = self.frame.withColumn(at, F.explode(filled))
        self.match(x, F.col(at))
        if g.out is not True:
            self.match(g.out, F.lit(True))
        return True

    def map_goal(self, g: Goal) -> bool:
        entries, rest = g.data
        if self.known(g.out):
            if not self.known([k for k, _ in entries]):
                return False
            m = self.column(g.out)
            keys = [self.column(k) for k, _ in entries]
            for k, (_, v) in zip(keys, entries, strict=True):
                self.where(F.map_contains_key(m, k))
                self.match(v, F.element_at(m, k))
            left = F.map_filter(m, lambda key, _: ~key.isin(keys)) if keys else m
            if rest is None:
                self.where(F.size(m) == len(keys))
            else:
                self.match(rest, left)
            return True
        if not self.known([(k, v) for k, v in entries]) or rest is not None and not self.known(rest):
            return False
        made = F.create_map(*(c for k, v in entries for c in (self.column(k), self.column(v)))) if entries else F.create_map()
        if rest is not None:
            keys = [self.column(k) for k, _ in entries]
            made = F.map_concat(F.map_filter(self.column(rest), lambda key, _: ~key.isin(keys)), made)
        self.match(g.out, made)
        return True

    def relational(self, todo: list[Goal], override: dict[int, DataFrame]) -> int | None:
        """Join the relation that shares most with what is known."""
        best = None
        for i, g in enumerate(todo):
            if g.kind == "call" and self.c.has_relation(g):
                shared = sum(self.known(a) for a in g.args if variables(a)) + (bool(variables(g.out)) and self.known(g.out))
                score = (-shared, i)
                if best is None or score < best[0]:
                    best = (score, i)
        if best is not None:
            g = todo[best[1]]
            self.join(self.c.relation_for(g, override.get(id(g))), g.args, g.out)
            return best[1]
        for i, g in enumerate(todo):
            if g.kind == "call" and self.known(g.args) and self.c.session.functor(g.name, len(g.args), self.c.file) is not None:
                self.demand(g)
                return i
        for i, g in enumerate(todo):
            if g.kind == "defined":
                self.defined(g, todo)
                return i
        for i, g in enumerate(todo):
            if g.kind == "inline":
                self.inline(g)
                return i
        return None

    def join(self, rel: DataFrame, args: tuple, out: Any, how: str = "inner") -> None:
        names = [f"r{next(_count)}" for _ in rel.columns]
        rel = rel.toDF(*names)
        n = len(args)
        places = [*zip(args, names[:n], strict=True)] + ([(out, names[n])] if len(names) > n else [])
        side = Body(self.c, rel, {}, {k: v for k, v in self.constants.items()})
        keys: list[Column] = []
        later: list[tuple[Any, str]] = []
        bound: dict[str, str] = {}
        for pattern, at in places:
            if isinstance(pattern, V) and pattern.name in self.columns:
                mine, theirs = self.frame.schema[self.columns[pattern.name]].dataType, rel.schema[at].dataType
                keys.append(F.col(self.columns[pattern.name]) == F.col(at) if comparable(mine, theirs, False) else F.lit(False))
            elif isinstance(pattern, V) and pattern.name not in self.constants:
                if pattern.name in bound:
                    side.where(F.col(bound[pattern.name]) == F.col(at))
                else:
                    bound[pattern.name] = at
            elif not variables(pattern) or side.known(pattern):
                side.match(pattern, F.col(at))
            else:
                later.append((pattern, at))
        for name, at in bound.items():
            # A column that the rule does not name is not read at all.
            if not name.startswith("_#") and side.frame.schema[at].nullable:
                side.where(F.col(at).isNotNull())
        right = side.frame
        if self.df is None:
            self.df = right
        elif keys:
            self.df = self.df.join(right, reduce(lambda a, b: a & b, keys), how)
        else:
            self.df = self.df.crossJoin(right)
        self.columns |= bound
        if isinstance(out, V) and len(names) > n + 1:
            self.columns[f"{out.name}$key"] = names[n + 1]
        for pattern, at in later:
            self.match(pattern, F.col(at))

    def demand(self, g: Goal) -> None:
        """A function of known arguments: its rules over the distinct arguments."""
        functor = self.c.session.functor(g.name, len(g.args), self.c.file)
        if not functor.rules:
            self.where(F.lit(False))
            return
        simple = len(functor.rules) == 1 and functor.rules[0].aggregator in ("=", ":=", "+=", "max=", "min=", "?=") and not self.c.recursive(functor)
        if simple and all(x.kind in ("call", "unify", "map") and not self.c.has_relation(x) for x in functor.rules[0].part.goals):
            part, head = self.c.renamed(functor.rules[0])
            for h, a in zip(head, g.args, strict=True):
                self.match(h, self.column(a))
            self.run(part.goals)
            self.match(g.out, self.column(part.value))
            return
        names = [f"a{i}" for i in range(len(g.args))]
        asked = self.frame.select(*(self.column(a).alias(n) for a, n in zip(g.args, names, strict=True))).distinct()
        if self.c.recursive(functor):
            found = self.c.local_rows(functor, asked)
        else:
            found = self.c.combined(functor.rules, lambda r: self.c.contribution(r, start=asked))
        cells = [f"d{next(_count)}" for _ in g.args]
        for a, at in zip(g.args, cells, strict=True):
            self.df = self.frame.withColumn(at, self.column(a))
        out = [f"r{next(_count)}" for _ in found.columns]
        found = found.toDF(*out)
        on = [F.col(c) == F.col(o) for c, o in zip(cells, out, strict=False)]
        self.df = self.frame.join(found, reduce(lambda a, b: a & b, on) if on else F.lit(True), "inner")
        self.match(g.out, F.col(out[len(g.args)]))

    def inner(self, part: Part, keep: set[str]) -> tuple[Body, list[str]]:
        """A sub-body on its own, and the variables it shares with this one."""
        body = Body(self.c, None, {}, self.constants).run(list(part.goals))
        return body, sorted(n for n in keep if n in body.columns)

    def defined(self, g: Goal, todo: list[Goal]) -> None:
        shared = {n for n in variables(g.data) if n in self.columns}
        body, keys = self.inner(g.data, shared)
        if set(keys) != shared:
            raise UnsafeRuleError(f"is_defined needs relations that hold {', '.join(sorted(shared - set(keys)))}")
        right = body.frame.select(*(F.col(body.columns[k]).alias(f"s_{k}") for k in keys))
        on = reduce(lambda a, b: a & b, [F.col(self.columns[k]) == F.col(f"s_{k}") for k in keys]) if keys else F.lit(True)
        negated = next((i for i, x in enumerate(todo) if x.kind == "call" and x.name == "!" and x.args == (g.out,) and x.out is True), None)
        if g.out is True:
            self.df = self.frame.join(right, on, "left_semi")
        elif negated is not None and isinstance(g.out, V):
            self.df = self.frame.join(right, on, "left_anti")
            self.constants[g.out.name] = False
        else:
            flag = f"x{next(_count)}"
            marked = right.distinct().withColumn(flag, F.lit(True)) if keys else right.limit(1).withColumn(flag, F.lit(True))
            self.df = self.frame.join(marked, on, "left")
            self.match(g.out, F.coalesce(F.col(flag), F.lit(False)))

    def inline(self, g: Goal) -> None:
        op, parts = g.data
        frames, keys = [], None
        for p in parts:
            shared = {n for n in variables(p) if n in self.columns}
            body, own = self.inner(p, shared)
            keys = own if keys is None else keys
            if own != keys:
                raise UnsafeRuleError("the parts of an inline aggregation depend on different variables")
            frames.append(body.frame.select(*(F.col(body.columns[k]).alias(f"a{i}") for i, k in enumerate(keys)), body.column(p.value).alias("v"), F.lit(len(frames)).alias("n")))
        found = self.c.aggregated(reduce(DataFrame.unionByName, frames), len(keys or ()), op)
        self.join(found, tuple(V(k) for k in keys or ()), g.out)


def is_type_test(p: Part) -> bool:
    return p.value is True and len(p.goals) == 1 and p.goals[0].kind == "call" and p.goals[0].out is True and len(p.goals[0].args) == 1 and p.goals[0].name in (*TYPES, "map", "list")


def has_type(t: DataType, name: str) -> bool:
    if name == "int":
        return whole(t)
    if name == "float":
        return t.simpleString() in ("double", "float")
    return isinstance(t, {"number": NumericType, "string": StringType, "bool": BooleanType, "map": MapType, "list": ArrayType}.get(name, StructType))


class Compiler:
    """Builds the DataFrames of a session's functors."""

    def __init__(self, session: Any, spark: SparkSession):
        self.session, self.spark, self.file = session, spark, "main"
        self.frames: dict[tuple, DataFrame] = {}
        self.kept: set[tuple] = set()
        self.pending: dict[tuple, DataFrame] = {}

    # What a call is -----------------------------------------------------------

    def depends(self, functor: Any, seen: set[tuple] | None = None) -> set[tuple]:
        """Keys of all functors that a functor's rules lead to."""
        seen = set() if seen is None else seen
        for r in functor.rules:
            for name, arity in called(r.part):
                f = self.session.functor(name, arity, r.file)
                if f is not None and f.key not in seen:
                    seen.add(f.key)
                    self.depends(f, seen)
        return seen

    def recursive(self, functor: Any) -> bool:
        return functor.key in self.depends(functor)

    def distributed(self, functor: Any) -> bool:
        return functor.frame is not None or any(self.session.functors[k].frame is not None for k in self.depends(functor))

    def has_relation(self, g: Goal) -> bool:
        if (g.name, len(g.args)) in BUILTINS or (g.name, len(g.args)) in self.session.functions:
            return False
        f = self.session.functor(g.name, len(g.args), self.file)
        if f is None:
            return True
        return f.key in self.pending or self.distributed(f) or self.listable(f)

    def listable(self, functor: Any) -> bool:
        """Whether a functor over values can be listed with all arguments free."""
        if functor.listable is None:
            if self.distributed(functor):
                functor.listable = False
            else:
                try:
                    functor.rows = self.session.local_answers(functor)
                    functor.listable = True
                except RuleError:
                    functor.listable = False
        return functor.listable

    def relation_for(self, g: Goal, override: DataFrame | None = None) -> DataFrame:
        if override is not None:
            return override
        f = self.session.functor(g.name, len(g.args), self.file)
        if f is None:
            schema = ", ".join([*(f"a{i} string" for i in range(len(g.args))), "v boolean"])
            return self.spark.createDataFrame([], schema)
        return self.relation(f)

    def is_plan_value(self, g: Goal, body: Body) -> bool:
        """Calls whose one value is an object or a structure to be called."""
        if (g.name, len(g.args)) in BUILTINS or variables(g.args) and not all(n in body.constants for n in variables(g.args)) or not isinstance(g.out, V):
            return False
        f = self.session.functor(g.name, len(g.args), self.file)
        if f is None or f.frame is not None or not f.rules:
            return False
        return any(x.kind in ("object", "lambda") for r in f.rules for x in r.part.goals)

    def plan_value(self, g: Goal, body: Body) -> bool:
        if g.kind == "method":
            target = body.value(g.args[0])
            if not isinstance(target, Handle):
                return False
            found = self.method(target, g.name, len(g.args) - 1)
            body.join(found, g.args[1:], g.out)
            return True
        if not all(n in body.constants for n in variables(g.args)):
            return False
        got = self.session.solve_local([g], {n: v for n, v in body.constants.items()}, [g.out])
        if not got:
            body.where(F.lit(False))
            return True
        body.constants[g.out.name] = got[0][0]
        return True

    # Relations ------------------------------------------------------------------

    def relation(self, functor: Any) -> DataFrame:
        if functor.frame is not None:
            return functor.frame
        if functor.key in self.pending:
            return self.pending[functor.key]
        done = self.frames.get(functor.key)
        if done is None:
            if not self.distributed(functor) and self.listable(functor):
                done = self.session.frame_of_rows(functor.rows, functor.arity)
            elif self.recursive(functor):
                from ruleframe.plans.fixpoint import solve

                self.frames |= solve(self, functor)
                done = self.frames[functor.key]
            else:
                done = self.combined(functor.rules, self.contribution)
                if functor.memo == "null":
                    # Kept as a table: every use reads it instead of computing it again.
                    from ruleframe.plans.fixpoint import checkpointed

                    done = checkpointed(done)
            self.frames[functor.key] = done
        return done

    def renamed(self, r: Rule) -> tuple[Part, tuple]:
        """A rule with variables of its own."""
        names: dict[str, V] = {}

        def new(x: Any) -> Any:
            if isinstance(x, V):
                return names.setdefault(x.name, V(f"{x.name}#{next(_count)}"))
            if isinstance(x, Term):
                return Term(x.name, tuple(map(new, x.args)))
            if isinstance(x, Goal):
                return Goal(x.kind, new(x.args), new(x.out), x.name, new(x.data))
            if isinstance(x, Part):
                return Part([new(y) for y in x.goals], new(x.value), new(x.key))
            if isinstance(x, (tuple, list)):
                return type(x)(new(y) for y in x)
            return x

        return new(r.part), new(r.head)

    def contribution(self, r: Rule, start: DataFrame | None = None, override: dict[int, DataFrame] | None = None, constants: dict[str, Any] | None = None) -> DataFrame:
        """Rows ``a0.., v [, k], n`` of one rule, before aggregation."""
        before, self.file = self.file, r.file
        try:
            if start is None and override is None and constants is None:
                found = self.ordered(r)
                if found is not None:
                    return found
            body = Body(self, None, {}, constants)
            if start is not None:
                body.df = start
                for h, c in zip(r.head, start.columns, strict=True):
                    body.match(h, F.col(c))
            body.run(list(r.part.goals), override)
            if not body.known((r.head, r.part.value, r.part.key)):
                raise UnsafeRuleError(f"{r.name}/{r.arity}: an argument or the value stays free")
            out = [body.column(h).alias(f"a{i}") for i, h in enumerate(r.head)]
            gone = r.aggregator == ":=" and (body.value(r.part.value) if isinstance(r.part.value, V) else r.part.value) == NULL
            out.append((F.lit(None) if gone else body.column(r.part.value)).alias("v"))
            if r.part.key is not None:
                out.append(body.column(r.part.key).alias("k"))
            return body.frame.select(*out, F.lit(r.number).alias("n"))
        finally:
            self.file = before

    def combined(self, rules: list[Rule], contribution: Any) -> DataFrame:
        """All rules of a functor, one aggregation for each aggregator used."""
        if len(rules) == 1 and contribution == self.contribution:
            product = self.product(rules[0])
            if product is not None:
                return product
        groups: dict[str, list[DataFrame]] = {}
        for r in rules:
            groups.setdefault(r.aggregator, []).append(contribution(r))
        arity = rules[0].arity
        if len(rules) == 1 and self.keeps_keys(rules[0]):
            # Each key has one value already, so there is nothing to aggregate.
            (frames,) = groups.values()
            return frames[0].drop("n").where(F.col("v").isNotNull())
        done = [self.aggregated(united(frames), arity, op) for op, frames in groups.items()]
        if len(done) == 1:
            return done[0]
        keys = [f"a{i}" for i in range(arity)]
        once = united(done).groupBy(*keys).agg(F.count(F.lit(1)).alias("c"), F.first("v").alias("v"))
        checked = F.when(F.col("c") == 1, F.col("v")).otherwise(F.raise_error(F.lit("several aggregators give a value to one key")).cast(once.schema["v"].dataType))
        return once.select(*keys, checked.alias("v"))

    def keeps_keys(self, r: Rule) -> bool:
        """Whether a rule gives each key one value, as it only renames or filters a derived relation."""
        if r.aggregator not in ("=", "+=", "*=", "max=", "min=", "?=", "|=", "&="):
            return False
        calls = [g for g in r.part.goals if g.kind != "unify"]
        relations = [g for g in calls if g.kind == "call" and self.has_relation(g)]
        if len(relations) != 1 or any(g.kind != "call" or (g is not relations[0] and g.name not in TESTS and (g.name, len(g.args)) not in MODES) for g in calls):
            return False
        f = self.session.functor(relations[0].name, len(relations[0].args), r.file)
        if f is None or f.frame is not None or f.key in self.pending:
            return False
        names = [a.name for a in relations[0].args if isinstance(a, V)]
        head = [h.name for h in r.head if isinstance(h, V)]
        return len(set(names)) == len(names) == sum(bool(variables(a)) for a in relations[0].args) and set(names) <= set(head)

    def aggregated(self, rows: DataFrame, arity: int, op: str) -> DataFrame:
        keys = [f"a{i}" for i in range(arity)]
        kind = rows.schema["v"].dataType
        if op == ":-":
            out = rows.select(*keys).distinct().withColumn("v", F.lit(True)) if keys else rows.limit(1).select(F.lit(True).alias("v"))
            return out
        group = rows.groupBy(*keys)
        extra = [F.count(F.lit(1)).alias("c")]
        if op == ":=":
            best = self.overridden(group, keys, kind, extra)
        elif op == "merge_map=":
            best = self.merged_maps(rows, keys, extra)
        elif "k" in rows.columns and op in ("max=", "min="):
            # Ties go to the least witness.
            if op == "min=":
                best = group.agg(F.min(F.struct("v", "k")).alias("w"), *extra)
            elif isinstance(kind, (DoubleType, FloatType)):
                best = group.agg(F.min(F.struct((-F.col("v")).alias("o"), "k", "v")).alias("w"), *extra)
            else:
                once = rows.groupBy(*keys, "v").agg(F.min("k").alias("k"))
                best = once.groupBy(*keys).agg(F.max(F.struct("v", "k")).alias("w"), *extra)
            best = best.select(*keys, F.col("w.v").alias("v"), F.col("w.k").alias("k"), "c")
        else:
            best = group.agg(AGGREGATORS[op].column(F.col("v"), kind).alias("v"), *extra)
        if not keys:
            best = best.where(F.col("c") > 0)
        return best.drop("c")

    @staticmethod
    def overridden(group: Any, keys: list[str], kind: DataType, extra: list[Column]) -> DataFrame:
        """The last rule that gives a value decides; two values of that one conflict, $null deletes."""
        if orderable(kind):
            best = group.agg(F.max(F.struct("n", "v")).alias("m"), F.min(F.struct((-F.col("n")).alias("n"), "v")).alias("l"), *extra)
            checked = F.when(F.col("m.v").eqNullSafe(F.col("l.v")), F.col("m.v")).otherwise(F.raise_error(F.lit(":= has several values")).cast(kind))
            best = best.select(*keys, checked.alias("v"), "c")
        else:
            best = group.agg(F.max_by("v", "n").alias("v"), *extra)
        best = best.where(F.col("v").isNotNull())
        return best.where(F.col("v.functor") != NULL.name) if isinstance(kind, StructType) and "functor" in kind.names else best

    @staticmethod
    def merged_maps(rows: DataFrame, keys: list[str], extra: list[Column]) -> DataFrame:
        """Entries are reduced by their key first; the largest value of a key stays."""
        entries = rows.select(*keys, F.explode_outer("v").alias("__key", "__value"))
        once = entries.groupBy(*keys, "__key").agg(F.max("__value").alias("__value"))
        entry = F.when(F.col("__key").isNotNull(), F.struct("__key", "__value"))
        return once.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("v"), *extra)

    # Aggregates over an inequality ---------------------------------------------------

    def ordered(self, r: Rule) -> DataFrame | None:
        """``f(A..) += B for p(A.., S), q(B, T), T <= S``: a running aggregate instead of all pairs."""
        sides = inequality_sides(r, self)
        if sides is None:
            return None
        near, far, shared, op, near_at, far_at = sides
        a, b = Body(self).run(near), Body(self).run(far)
        value, head = r.part.value, r.head
        if not (a.known(head) and b.known(value) and all(n in a.columns and n in b.columns for n in shared) and near_at in a.columns and far_at in b.columns):
            return None
        pairs = [(a.type_of(F.col(a.columns[n])), b.type_of(F.col(b.columns[n]))) for n in (*shared,)]
        places = (a.type_of(F.col(a.columns[near_at])), b.type_of(F.col(b.columns[far_at])))
        kind = b.type_of(b.column(value))
        if not all(comparable(x, y, False) for x, y in pairs) or not (comparable(*places, True)) or r.aggregator == "+=" and not isinstance(kind, NumericType):
            return None
        from ruleframe.operators.running import running_aggregate

        keys = [f"k{i}" for i in range(len(shared))]
        asks = a.frame.select(*(F.col(a.columns[n]).alias(k) for n, k in zip(shared, keys, strict=True)), F.col(a.columns[near_at]).alias("at"), *(a.column(h).alias(f"a{i}") for i, h in enumerate(head)))
        gives = b.frame.select(*(F.col(b.columns[n]).alias(k) for n, k in zip(shared, keys, strict=True)), F.col(b.columns[far_at]).alias("at"), b.column(value).alias("v"))
        found = running_aggregate(asks, gives, keys, r.arity, op, r.aggregator, whole(kind))
        return found.select(*(f"a{i}" for i in range(r.arity)), "v", F.lit(r.number).alias("n"))

    # Products of relations ---------------------------------------------------------

    def product(self, r: Rule) -> DataFrame | None:
        """``f(A.., B..) += p(A.., L) * q(B.., L)`` over derived relations, aggregated: in
        blocks where that is less than shuffling the pairs."""
        before, self.file = self.file, r.file
        try:
            calls = product_sides(r, self)
            if calls is None:
                return None
            from ruleframe.operators.product import block_product, simple
            from ruleframe.plans.fixpoint import checkpointed

            shared = (variables(calls[0].args) & variables(calls[1].args)).pop()
            kinds = []
            for g in calls:
                fields = self.relation_for(g).schema
                own = {"l" if a.name == shared else a.name: fields[f"a{i}"].dataType for i, a in enumerate(g.args)}
                if not isinstance(fields["v"].dataType, DoubleType) or not all(map(simple, own.values())):
                    return None
                kinds.append(own["l"])
            if kinds[0] != kinds[1] or any(self.relation_for(g).isStreaming for g in calls):
                return None
            for f in (self.session.functor(g.name, len(g.args), r.file) for g in calls):
                # Counted and read for each side.
                if f.key not in self.kept:
                    self.frames[f.key] = checkpointed(self.relation(f))
                    self.kept.add(f.key)
            names, frames = {}, []
            for g, letter in zip(calls, "ab", strict=True):
                body = Body(self).run([g])
                own = [a.name for a in g.args if a.name != shared]
                names |= {n: f"{letter}{i}" for i, n in enumerate(own)}
                frames.append(body.frame.select(*(F.col(body.columns[n]).alias(names[n]) for n in own), F.col(body.columns[shared]).alias("l"), F.col(body.columns[g.out.name]).alias("v")))
            found = block_product(*frames)
            return found and found.select(*(F.col(names[h.name]).alias(f"a{i}") for i, h in enumerate(r.head)), "v")
        finally:
            self.file = before

    def method(self, target: Handle, name: str, arity: int) -> DataFrame:
        frames: dict[str, list[DataFrame]] = {}
        for number, values in target.classes:
            names, rules = self.session.classes[number]
            for r in rules.get((name, arity), ()):
                env = {**dict(zip(names, values, strict=True)), "$self": target}
                frames.setdefault(r.aggregator, []).append(self.contribution(r, constants=env))
        if not frames:
            return self.relation_for(Goal("call", (None,) * arity, None, "$undefined"))
        return united([self.aggregated(united(f), arity, op) for op, f in frames.items()])

    def local_rows(self, functor: Any, asked: DataFrame) -> DataFrame:
        """Values of a recursive function for distinct arguments.

        Up to ``DEMAND_ROWS`` are computed on the driver; beyond it each task
        evaluates its own, and the first ones tell the types.
        """
        rows = asked.limit(DEMAND_ROWS + 1).collect()
        session, key, arity = self.session, functor.key, functor.arity
        found = [a for r in rows[:DEMAND_ROWS] for a in session.local_answers(functor, tuple(map(session.to_value, r)))]
        known = session.frame_of_rows(found, arity)
        if len(rows) <= DEMAND_ROWS:
            return known

        def run(batches: Any) -> Any:
            import pandas as pd

            for batch in batches:
                given = (tuple(map(session.to_value, r)) for r in batch.itertuples(index=False, name=None))
                yield pd.DataFrame(session.encoded_rows([a for g in given for a in session.local_answers(session.functors[key], g)], kinds), columns=names)

        names, kinds = known.columns, [f.dataType for f in known.schema]
        return asked.mapInPandas(run, known.schema)


FLIP = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}


def inequality_sides(r: Rule, compiler: Compiler) -> tuple | None:
    """The two relations of a body that share variables and one inequality.

    (goals of the side of the head, goals of the other, shared names, the
    inequality as seen from the other side, its names on both sides), or None.
    """
    goals = r.part.goals
    relations = [g for g in goals if g.kind == "call" and compiler.has_relation(g)]
    if r.aggregator not in ("+=", "max=", "min=") or r.part.key is not None or len(relations) != 2:
        return None
    sides, names = [[g] for g in relations], [variables(g) for g in relations]
    shared = names[0] & names[1]
    if any(n in variables(g.out) for g in relations for n in shared):
        return None
    todo = [g for g in goals if g not in relations]
    moved = True
    while moved:
        moved = False
        for g in todo:
            if g.kind not in ("unify", "call", "map"):
                return None
            own = variables(g)
            touched = [i for i in (0, 1) if own & (names[i] - shared)]
            if len(touched) == 2 or not own & (names[0] | names[1]):
                continue
            i = touched[0] if touched else 0
            sides[i].append(g)
            names[i] |= own
            todo.remove(g)
            moved = True
            break
    if len(todo) != 1 or todo[0].name not in FLIP or todo[0].out is not True or not all(isinstance(x, V) for x in todo[0].args):
        return None
    for near in (0, 1):
        far = 1 - near
        x, y = (v.name for v in todo[0].args)
        value = variables(r.part.value)
        if variables(r.head) <= names[near] and value <= names[far] - shared and not (names[0] & names[1]) - shared:
            if x in names[far] - shared and y in names[near] - shared:
                return sides[near], sides[far], sorted(shared), todo[0].name, y, x
            if y in names[far] - shared and x in names[near] - shared:
                return sides[near], sides[far], sorted(shared), FLIP[todo[0].name], x, y
    return None


def product_sides(r: Rule, compiler: Compiler) -> list[Goal] | None:
    """The two derived relations of a body that sums products of their values over one
    shared variable, and whose other variables are the head; or None."""
    goals = r.part.goals
    relations = [g for g in goals if g.kind == "call" and compiler.has_relation(g)]
    times = [g for g in goals if g.kind == "call" and g.name == "*"]
    if r.aggregator != "+=" or r.part.key is not None or len(goals) != 3 or len(relations) != 2 or len(times) != 1:
        return None
    if not all(isinstance(x, V) for g in relations for x in (*g.args, g.out)) or not all(isinstance(h, V) for h in r.head):
        return None
    functors = [compiler.session.functor(g.name, len(g.args), r.file) for g in relations]
    if any(f is None or f.frame is not None or f.key in compiler.pending for f in functors):
        return None
    names, outs = [[x.name for x in g.args] for g in relations], [g.out.name for g in relations]
    shared, head = set(names[0]) & set(names[1]), [h.name for h in r.head]
    every = [*names[0], *names[1]]
    if len(shared) != 1 or len(set(every)) != len(every) - 1 or any(len(n) < 2 for n in names) or set(outs) & set(every) or len(set(outs)) != 2:
        return None
    if sorted(head) != sorted(set(every) - shared) or times[0].out != r.part.value or not isinstance(times[0].out, V) or times[0].out.name in {*every, *outs}:
        return None
    return relations if all(isinstance(x, V) for x in times[0].args) and sorted(x.name for x in times[0].args) == sorted(outs) else None


def orderable(t: DataType) -> bool:
    return "map<" not in t.simpleString()


def united(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def called(x: Any) -> set[tuple[str, int]]:
    """Names and arities that goals call."""
    if isinstance(x, Goal):
        own = {(x.name, len(x.args))} if x.kind == "call" else set()
        return own | called(x.data) | called(x.args)
    if isinstance(x, Part):
        return called(x.goals)
    if isinstance(x, Term):
        return {(x.name, n) for n in range(len(x.args), len(x.args) + 3)} if x.args else set()
    if isinstance(x, (tuple, list)):
        return set().union(*map(called, x)) if x else set()
    return set()
