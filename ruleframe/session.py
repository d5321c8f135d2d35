"""Sessions: programs, registered DataFrames, host functions and queries."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DecimalType, DoubleType, LongType, MapType, StringType, StructField, StructType

from ruleframe.functions.scalar import BUILTINS, FREE, hash_unit
from ruleframe.operators.aggregators import AGGREGATORS
from ruleframe.plans.compile import Compiler, called, widened
from ruleframe.plans.local import LISTING_ROUNDS, MOST_ROUNDS, Evaluator, Slot, fill, ground, resolve, with_deep_stack
from ruleframe.plans.parser import parse, parse_expression
from ruleframe.plans.rules import Goal, Normaliser, Part, Rule, V, rules_of, variables
from ruleframe.plans.terms import AssertionFailed, FrozenMap, Handle, Keyed, Opaque, RuleError, SyntaxProblem, SystemTermError, Term, UnsafeRuleError, cons, is_list, show, to_host, to_value, uncons

#: Rule files that any program can import by name.
LIBRARY = Path(__file__).parent / "library"
MEMO_LINES = 1000
SYSTEM_NAMES = {name for name, _ in BUILTINS} | {"is_defined", "random"}


@dataclass
class Functor:
    """A named relation: rules, or a registered DataFrame."""

    file: str
    name: str
    arity: int
    rules: list[Rule] = field(default_factory=list)
    frame: DataFrame | None = None
    listable: bool | None = None
    rows: list = field(default_factory=list)
    memo: str = "none"
    priority: Any = None

    @property
    def key(self) -> tuple[str, str, int]:
        return self.file, self.name, self.arity


@dataclass
class Answer:
    """Result of a query: bindings of its free variables and its value."""

    variables: tuple[str, ...]
    rows: list[tuple]

    @property
    def values(self) -> list[Any]:
        return [r[-1] for r in self.rows]


class ObjectHandle:
    """An object as the host sees it: attributes are its methods."""

    def __init__(self, session: Session, handle: Handle):
        self._session, self._handle = session, handle

    def __getattr__(self, name: str) -> Any:
        if name.startswith("_"):
            raise AttributeError(name)

        def method(*args: Any) -> Any:
            given = (self._handle, *map(self._session.to_value, args))
            goal = Goal("method", tuple(V(f"p{i}") for i in range(len(given))), V("out"), name)
            rows = self._session.solve_local([goal], {f"p{i}": a for i, a in enumerate(given)}, [V("out")])
            if not rows:
                raise RuleError(f"{name} has no value")
            return self._session.to_host(rows[0][0])

        return method

    def get(self, name: str) -> Any:
        return getattr(self, name)()


class Session:
    """Holds a program and answers queries on it.

    Whole numbers of registered DataFrames become 64-bit.  Names are scoped by
    file; ``import`` and ``export`` connect files.
    """

    def __init__(self, spark: SparkSession | None = None):
        self.spark = spark
        self.functors: dict[tuple[str, str, int], Functor] = {}
        self.functions: dict[tuple[str, int], Callable] = {}
        self.udfs: dict[tuple[str, int], Any] = {}
        self.imports: dict[str, dict[tuple[str, int], str]] = {}
        self.exports: dict[str, set[tuple[str, int]]] = {}
        self.system: dict[tuple[str, int], str] = {}
        self.macros: dict[tuple[str, int], list[tuple[tuple, Term]]] = {}
        self.macro_names: set[tuple[str, int]] = set()
        self.disposed: dict[tuple[str, int], tuple[str, ...]] = {}
        self.classes: dict[int, tuple[tuple[str, ...], dict[tuple[str, int], list[Rule]]]] = {}
        self._class_numbers: dict[tuple[int, tuple[str, ...]], int] = {}
        self._class_files: dict[int, str] = {}
        self.pragmas: dict[str, Callable] = {}
        self.printed: list[str] = []
        self.answers: list[Any] = []
        self.arguments: list[str] = []
        self.evaluator = Evaluator(self)
        self._compiler: Compiler | None = None
        self._folder: dict[str, Path] = {}
        self.to_value, self.to_host = self._in, self._out
        self.functions["$command_line_args", 0] = lambda out: [(cons(self.arguments),)]
        self.functions["$read_csv", 1] = self._read_csv
        self.agenda: dict[tuple, Functor] = {}
        self.seed = 0
        self.functions["$random_seed", 0] = lambda out: [(self.seed,)]
        self.functions["random", 1] = self._random
        self.functions["random", 3] = self._random

    # Memoised functors ------------------------------------------------------------

    def run_agenda(self) -> list[str]:
        """Compute what is to be kept in full (``"null"``) and is out of date, the
        highest priority first; the names in the order of their turn."""
        done = []
        for f in sorted(self.agenda.values(), key=lambda f: (-self.rank(f), f.key)):
            if self.spark is not None and self.compiler.distributed(f):
                with_deep_stack(lambda f=f: self.compiler.relation(f))
            else:
                f.rows, f.listable = self.local_answers(f), True
            done.append(f"{f.name}/{f.arity}")
        self.agenda.clear()
        return done

    @staticmethod
    def rank(functor: Functor) -> float:
        """A constant ``$priority``; one that depends on the arguments counts as 0."""
        p = functor.priority
        sign = -1 if p is not None and p.name == "$neg" else 1
        p = p[0] if sign < 0 else p
        return sign * p[0] if p is not None and p.name == "$constant" and isinstance(p[0], (int, float)) else 0

    def memo_table(self, name: str, arity: int, file: str = "main") -> list[str]:
        """What is kept of a functor at the moment, as lines of text."""
        f = self.functor(name, arity, file)
        if f is None:
            return [f"{name}/{arity} is not defined"]
        if self.spark is not None and f.key in self.compiler.frames:
            rows = [tuple(map(self.to_value, r)) for r in self.compiler.frames[f.key].limit(MEMO_LINES).collect()]
        else:
            rows = [(*row, value) for (key, _), found in self.evaluator.tables.items() if key == f.key for row, value in found]
        return sorted({f"{name}({', '.join(map(show, r[:arity]))}) = {show(r[arity])}" for r in rows})

    # Names --------------------------------------------------------------------

    def functor(self, name: str, arity: int, file: str) -> Functor | None:
        key = (name, arity)
        for place in (file, self.imports.get(file, {}).get(key), self.system.get(key)):
            found = self.functors.get((place, name, arity)) if place is not None else None
            if found is not None and (found.rules or found.frame is not None):
                return found
        return None

    def changed(self) -> None:
        """The program changed: results that were kept no longer hold."""
        self.evaluator = Evaluator(self)
        self._compiler = None
        for f in self.functors.values():
            f.listable = None
            if f.memo == "null" and f.rules:
                self.agenda[f.key] = f

    @property
    def compiler(self) -> Compiler:
        if self._compiler is None:
            if self.spark is None:
                raise RuleError("this session has no SparkSession")
            self._compiler = Compiler(self, self.spark)
        return self._compiler

    def __getstate__(self) -> dict[str, Any]:
        """What tasks need to evaluate rules over values: no session, frames or results."""
        kept = {k: replace(f, frame=None, rows=[], listable=None) for k, f in self.functors.items()}
        return {**self.__dict__, "spark": None, "udfs": {}, "functors": kept, "evaluator": None, "_compiler": None, "answers": [], "printed": [], "agenda": {}}

    def __setstate__(self, state: dict[str, Any]) -> None:
        self.__dict__.update(state)
        self.evaluator = Evaluator(self)

    # Values -------------------------------------------------------------------

    def _in(self, x: Any) -> Any:
        if isinstance(x, ObjectHandle):
            return x._handle
        if isinstance(x, (list, tuple)):
            return cons(map(self._in, x))
        if isinstance(x, dict):
            return FrozenMap((self._in(k), self._in(v)) for k, v in x.items())
        return to_value(x)

    def _out(self, x: Any) -> Any:
        if isinstance(x, Handle):
            return ObjectHandle(self, x)
        if is_list(x):
            return [self._out(i) for i in uncons(x)]
        if isinstance(x, Keyed):
            return self._out(x.value)
        return to_host(x)

    def _read_csv(self, path: Any, out: Any) -> list[tuple] | None:
        """A CSV file as a list of lists of strings; for small files."""
        if path is FREE:
            return None
        if self.spark is not None:
            from ruleframe.sources.csvio import read_csv

            rows = [list(r) for r in read_csv(self.spark, path).collect()]
        else:
            import csv

            with open(path, newline="") as f:
                rows = list(csv.reader(f))
        return [(path, self._in(rows))]

    def _random(self, key: Any, *rest: Any) -> list[tuple] | None:
        """``random(key)`` in [0, 1), ``random(key, low, high)``; the same for equal keys and ``seed``."""
        *bounds, _ = rest
        if key is FREE or FREE in bounds:
            return None
        low, high = bounds or (0.0, 1.0)
        return [(key, *bounds, low + (high - low) * hash_unit(key, self.seed))]

    # Registration ---------------------------------------------------------------

    def register(self, name: str, df: DataFrame, key: list[str] | None = None, value: str | None = None, file: str = "main") -> Functor:
        """Make a DataFrame a relation of its ``key`` columns (all others than
        ``value`` by default); without a value column its value is true."""
        key = key if key is not None else [c for c in df.columns if c != value]
        df = widened(df.select(*(F.col(f"`{c}`").alias(f"a{i}") for i, c in enumerate(key)), (F.col(f"`{value}`") if value else F.lit(True)).alias("v")))
        functor = Functor(file, name, len(key), frame=df)
        self.functors[functor.key] = functor
        self.changed()
        return functor

    def define_function(self, name: str, arity: int | None = None, returns: str | None = None, batch: bool = False) -> Callable:
        """Decorator: a pure host function, called when all arguments are known.

        ``returns`` is the type of the column where the function is used on
        DataFrames; it runs there in Arrow batches.  With ``batch`` the function
        takes and returns whole columns (pandas Series) instead of single values.
        """

        def add(f: Callable) -> Callable:
            n = arity if arity is not None else len(inspect.signature(f).parameters)

            def run(*args: Any) -> Any:
                *given, _ = args
                if any(a is FREE for a in given):
                    return None
                if batch:
                    import pandas as pd

                    return [(*given, self._in(f(*(pd.Series([self._out(a)]) for a in given)).tolist()[0]))]
                return [(*given, self._in(f(*map(self._out, given))))]

            self.functions[name, n] = run
            if returns:
                self.udfs[name, n] = F.pandas_udf(f, returns) if batch else F.udf(lambda *args: f(*map(_whole, args)), returns, useArrow=True)
            self.changed()
            return f

        return add

    # Programs -------------------------------------------------------------------

    def execute(self, text: str, *params: Any, file: str = "main") -> None:
        """Run a program's statements in order; ``$0`` .. are ``params``."""
        frames = {f"$param{i}": p for i, p in enumerate(params) if isinstance(p, DataFrame)}
        values = tuple(Term(f"$param{i}") if isinstance(p, DataFrame) else self._in(p) for i, p in enumerate(params))
        for name, df in frames.items():
            self.register(name, df, file=file)
        for statement in parse(text):
            self.statement(statement, file, values)

    run = execute

    def run_file(self, path: str | Path) -> None:
        path = Path(path)
        file = str(path.resolve())
        if file in self._folder:
            return
        self._folder[file] = path.resolve().parent
        self.execute(path.read_text(), file=file)

    def query(self, text: str, *params: Any, file: str = "main") -> Any:
        """Answers of the queries in a program text, one for each ``?``.

        One query gives its answer itself: a DataFrame if it depends on
        registered DataFrames, the value if no variable is free, else an
        :class:`Answer`.
        """
        before, self.answers = self.answers, []
        try:
            self.execute(text, *params, file=file)
            got = self.answers
        finally:
            self.answers = before
        return got[0] if len(got) == 1 else got

    def relation(self, name: str, arity: int, file: str = "main") -> DataFrame:
        """The whole relation of a functor: ``a0 ..``, ``v`` and maybe ``k``."""
        functor = self.functor(name, arity, file)
        if functor is None:
            raise RuleError(f"{name}/{arity} is not defined")
        return with_deep_stack(lambda: self.compiler.relation(functor))

    def explain(self, name: str, arity: int) -> str:
        return self.relation(name, arity)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def normaliser(self, params: tuple = ()) -> Normaliser:
        return Normaliser(params, self.disposed, self.expand, (self._file_now, "$query", 0))

    def statement(self, tree: Term, file: str, params: tuple) -> None:
        if tree.name == "$define":
            self.define(tree, file, params)
        elif tree.name == "$pragma":
            self.pragma(tree[0], tree[1], file)
        elif tree.name in ("$query", "$assert", "$assert_fails", "$print"):
            with_deep_stack(lambda: self.ask(tree, file, params))
        else:
            raise SyntaxProblem(f"{tree.name} is no statement")

    def define(self, tree: Term, file: str, params: tuple) -> None:
        head = tree[0]
        if head.name == "$memo" or head.name == "$priority":
            target = head[0]
            name, args = (target[0], target.args[1:]) if target.name == "$struct" else (target.name, target.args)
            functor = self.functors.setdefault((file, name, len(args)), Functor(file, name, len(args)))
            value = tree[2][0][0]
            if head.name == "$memo":
                mode = value[0] if value.name == "$constant" else None
                if mode not in ("null", "unk", "none"):
                    raise SyntaxProblem('$memo takes "null", "unk" or "none"')
                functor.memo = mode
            else:
                functor.priority = value
            self.changed()
            return
        name, trees = (head[0], head.args[1:]) if head.name == "$struct" else (head.name, head.args)
        key = (name, len(trees))
        if key in self.macro_names:
            self.macros.setdefault(key, []).append((trees, tree[2][0][0]))
            self.changed()
            return
        if (name in SYSTEM_NAMES and (key in BUILTINS or name in ("is_defined", "random"))) or self.system.get(key, file) != file:
            raise SystemTermError(f"{name}/{len(trees)} is a system defined term")
        made = rules_of(tree, file, self.normaliser(params))
        functor = self.functors.setdefault((file, *key), Functor(file, *key))
        if functor.frame is not None:
            raise RuleError(f"{name}/{len(trees)} is a registered DataFrame")
        functor.rules += made
        self.changed()

    def object_class(self, statements: tuple, captured: tuple[str, ...]) -> int:
        """Class of the objects that one place in a program makes."""
        place = (id(statements), captured)
        number = self._class_numbers.get(place)
        if number is None:
            number = self._class_numbers[place] = len(self.classes)
            rules: dict[tuple[str, int], list[Rule]] = {}
            for s in statements:
                if s.name != "$define":
                    raise SyntaxProblem("an object holds definitions only")
                for r in rules_of(s, self._file_now, self.normaliser(), captured):
                    rules.setdefault((r.name, r.arity), []).append(r)
            self.classes[number] = (captured, rules)
            self._kept.append(statements)
        return number

    _file_now = "main"
    _kept: list = []

    # Macros -----------------------------------------------------------------------

    def expand(self, tree: Term) -> Term | None:
        """Expansion of a macro call, if the tree is one."""
        rules = self.macros.get((tree.name, len(tree.args)))
        if not rules:
            return None
        for patterns, body in reversed(rules):
            found: dict[str, Term] = {}
            if all(_match_tree(p, a, found) for p, a in zip(patterns, tree.args, strict=True)):
                return _build_tree(body, found)
        return None

    # Queries ------------------------------------------------------------------------

    def distributed(self, part: Part, file: str) -> bool:
        if self.spark is None:
            return False
        for name, arity in called(part):
            f = self.functor(name, arity, file)
            if f is not None and (f.frame is not None or self.compiler.distributed(f)):
                return True
        return False

    def ask(self, tree: Term, file: str, params: tuple) -> None:
        self._file_now = file
        if self.agenda:
            self.run_agenda()
        inner = self.normaliser(params)
        value = inner.value(tree[0])
        part = Part(inner.goals, value)
        names = tuple(sorted(n for n in variables(part) if "#" not in n and not n.startswith("$")))
        if tree.name == "$query" and self.distributed(part, file):
            self.answers.append(self.frame_answer(part, names, file))
            return
        if tree.name == "$query":
            rows = [tuple(self._out(x) for x in r) for r in self.solve_local(part.goals, {}, [*map(V, names), value], file)]
            self.answers.append(rows[0][0] if len(rows) == 1 and not names else Answer((*names, "value"), rows))
            return
        if self.distributed(part, file):
            rows = [(r[-1],) for r in self.frame_answer(part, (), file).limit(1).collect()]
        else:
            rows = self.solve_local(part.goals, {}, [value], file, most=None if tree.name == "$print" else 1, true=tree.name != "$print")
        holds = any(r[0] is not False for r in rows)
        if tree.name == "$print":
            self.printed += [show(r[0]) for r in rows] or ["no results"]
        elif holds != (tree.name == "$assert"):
            raise AssertionFailed(f"{'assert' if tree.name == '$assert' else 'assert_fails'} {tree[1]}")

    def frame_answer(self, part: Part, names: tuple[str, ...], file: str) -> DataFrame:
        rule = Rule("$query", tuple(map(V, names)), "=", part, 0, file)
        df = self.compiler.contribution(rule).drop("n")
        return df.toDF(*names, "value", *df.columns[len(names) + 1 :])

    def solve_local(self, goals: list[Goal], env: dict[str, Any], out: list[Any], file: str = "main", most: int | None = None, true: bool = False) -> list[tuple]:
        """Solutions of goals over values."""

        def run() -> list[tuple]:
            found: list[tuple] = []
            slots = dict(env)
            used = set().union(*(variables(o) for o in out)) | set(env)
            for _ in self.evaluator.solve(list(goals), slots, file, used):
                row = tuple(resolve(fill(o, slots)) for o in out)
                if true and row[-1] is False:
                    continue
                if not all(map(ground, row)) and most is None:
                    raise UnsafeRuleError("an answer is not fully known")
                found.append(row)
                if most is not None and len(found) >= most:
                    break
            return found

        try:
            return with_deep_stack(run)
        finally:
            self.evaluator.trail.undo(0)
            self.evaluator.running.clear()

    def local_answers(self, functor: Functor, args: tuple | None = None) -> list[tuple]:
        """Rows (arguments, value) of a functor over values."""

        def run() -> list[tuple]:
            given = tuple(Slot(f"a{i}") for i in range(functor.arity)) if args is None else args
            out = Slot("v")
            return [(*map(resolve, given), resolve(out)) for _ in self.evaluator.functor(functor, given, out)]

        self.evaluator.rounds = MOST_ROUNDS if args is not None else LISTING_ROUNDS
        try:
            return with_deep_stack(run)
        finally:
            self.evaluator.rounds = MOST_ROUNDS
            self.evaluator.trail.undo(0)
            self.evaluator.running.clear()

    def rows_of(self, functor: Functor) -> list[tuple]:
        """A registered DataFrame's rows for a statement over values; bounded."""
        rows = functor.frame.limit(100_001).collect()
        if len(rows) > 100_000:
            raise RuleError(f"{functor.name}/{functor.arity} is too large for a statement over values")
        return [tuple(map(self._in, r)) for r in rows]

    # DataFrames of values ---------------------------------------------------------------

    def frame_of_rows(self, rows: list[tuple], arity: int) -> DataFrame:
        """Rows of values as a DataFrame ``a0 .., v`` (and ``k`` with witnesses)."""
        keyed = any(isinstance(r[-1], Keyed) for r in rows)
        plain = [(*r[:-1], r[-1].value, r[-1].key) if isinstance(r[-1], Keyed) else (*r, None) if keyed else r for r in rows]
        names = [*(f"a{i}" for i in range(arity)), "v", *(["k"] if keyed else [])]
        kinds = [common_type([r[i] for r in plain]) for i in range(len(names))]
        data = self.encoded_rows(plain, kinds)
        schema = StructType([StructField(n, t, True) for n, t in zip(names, kinds, strict=True)])
        return self.spark.createDataFrame(data, schema)

    @staticmethod
    def encoded_rows(rows: list[tuple], kinds: list[DataType]) -> list[tuple]:
        return [tuple(encoded(x, t) for x, t in zip(r, kinds, strict=True)) for r in rows]

    # Pragmas ------------------------------------------------------------------------

    def pragma(self, name: str, parts: tuple, file: str) -> None:
        items = [(p.name, p.args) for p in parts if isinstance(p, Term)]
        pairs = [p.args for p in parts if isinstance(p, Term) and p.name == "/"]
        if name == "export":
            self.exports.setdefault(file, set()).update(pairs)
        elif name in ("import", "from"):
            target = next(p for p in parts if isinstance(p, str) and p not in (",", "from", "import"))
            folder = self._folder.get(file, Path.cwd())
            path = next((q for q in (folder / target, folder / f"{target}.rules") if q.exists()), None)
            path = path or next((q for q in folder.glob(f"{target}.*") if q.is_file()), None)
            # What is nowhere near the file may be one of the libraries that come along.
            path = path or next((q for q in (LIBRARY / f"{target}.rules",) if q.exists()), None)
            if path is None:
                raise RuleError(f"{target} is not found")
            self.run_file(path)
            source = str(path.resolve())
            for key in pairs or self.exports.get(source, ()):
                self.imports.setdefault(file, {})[tuple(key)] = source
            self.changed()
        elif name in ("make_system_term", "make_global_term"):
            for key in pairs:
                self.system[tuple(key)] = file
        elif name == "macro":
            self.macro_names.update(map(tuple, pairs))
        elif name == "dispose":
            for functor, how in items:
                self.disposed[functor, len(how)] = tuple(str(h) for h in how)
        elif name == "memoize_unk":
            for n, a in pairs:
                self.functors.setdefault((file, n, a), Functor(file, n, a)).memo = "unk"
        elif name in ("import_csv", "csv_import"):
            from ruleframe.sources.csvio import import_csv

            import_csv(self, *pairs[0], next(p for p in parts if isinstance(p, str) and p != ","), file)
        elif name in ("export_csv", "csv_export"):
            from ruleframe.sources.csvio import export_csv

            export_csv(self, *pairs[0], next(p for p in parts if isinstance(p, str) and p != ","), file)
        elif name == "run_agenda":
            self.run_agenda()
        elif name == "clear_agenda":
            self.agenda.clear()
        elif name == "print_memo_table":
            for n, a in pairs:
                self.printed += self.memo_table(n, a, file)
        elif name in ("set_recursion_limit", "use_optimized_rexprs"):
            return
        elif name in self.pragmas:
            self.pragmas[name](self, parts, file)
        else:
            raise RuleError(f"unknown pragma {name}")


def _whole(x: Any) -> Any:
    """Whole numbers of 38 digits as Python's."""
    from decimal import Decimal

    return int(x) if isinstance(x, Decimal) and x == x.to_integral_value() else x


def _match_tree(pattern: Term, tree: Term, found: dict[str, Term]) -> bool:
    """A macro's pattern: variables take trees, back-quoted parts match as they are."""
    if pattern.name == "$variable":
        found[pattern[0]] = tree
        return True
    if pattern.name == "$backquote":
        return _match_quoted(pattern[0], tree, found)
    if pattern.name == "$struct":
        return tree.name == pattern[0] and len(tree.args) == len(pattern.args) - 1 and all(map(lambda p, t: not isinstance(t, Term) or _match_tree(p, t, found), pattern.args[1:], tree.args))
    return pattern == tree


def _match_quoted(pattern: Any, tree: Any, found: dict[str, Term]) -> bool:
    if isinstance(pattern, Term) and pattern.name == "$backquote":
        return _match_tree(pattern[0], tree, found)
    if isinstance(pattern, Term) and isinstance(tree, Term):
        return pattern.name == tree.name and len(pattern) == len(tree) and all(_match_quoted(p, t, found) for p, t in zip(pattern.args, tree.args, strict=True))
    return pattern == tree


def _build_tree(body: Term, found: dict[str, Term]) -> Term:
    """The tree a macro's body stands for."""
    if body.name == "$variable":
        return found.get(body[0], body)
    if body.name == "$backquote":
        return _fill_quoted(body[0], found)
    if body.name == "$struct":
        if body[0] == "$constant" and isinstance(body[1], Term) and body[1].name == "$constant":
            return body[1]
        if body[0] == "$variable" and body[1].name == "$constant":
            return Term("$variable", (body[1][0],))
        return Term(body[0], tuple(_build_tree(a, found) for a in body.args[1:]))
    if body.name == "$constant" and isinstance(body[0], Term):
        return body[0]
    return Term(body.name, tuple(_build_tree(a, found) if isinstance(a, Term) else a for a in body.args))


def _fill_quoted(tree: Any, found: dict[str, Term]) -> Any:
    if isinstance(tree, Term):
        if tree.name == "$backquote":
            return _build_tree(tree[0], found)
        return Term(tree.name, tuple(_fill_quoted(a, found) for a in tree.args))
    if isinstance(tree, tuple):
        return tuple(_fill_quoted(a, found) for a in tree)
    return tree


def common_type(values: list[Any]) -> DataType:
    """Column type that holds all values; mixed kinds become their text."""
    values = [v.value if isinstance(v, Keyed) else v for v in values if v is not None]
    if not values:
        return StringType()
    if all(isinstance(v, bool) for v in values):
        return BooleanType()
    if all(isinstance(v, int) and not isinstance(v, bool) for v in values):
        size = max(map(abs, values))
        return LongType() if size < 1 << 63 else DecimalType(38, 0) if size < 10**38 else StringType()
    if all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values):
        return DoubleType()
    if all(isinstance(v, str) for v in values):
        return StringType()
    if all(map(is_list, values)):
        return ArrayType(common_type([i for v in values for i in uncons(v)]))
    if all(isinstance(v, FrozenMap) for v in values):
        return MapType(common_type([k for v in values for k in v]), common_type([x for v in values for x in v.values()]))
    if all(isinstance(v, Term) for v in values) and len({(v.name, len(v)) for v in values}) == 1:
        n = len(values[0])
        return StructType([StructField("functor", StringType()), *(StructField(f"x{i}", common_type([v.args[i] for v in values])) for i in range(n))])
    return StringType()


def encoded(x: Any, t: DataType) -> Any:
    from decimal import Decimal

    x = x.value if isinstance(x, Keyed) else x
    if x is None:
        return None
    if isinstance(t, StringType):
        return x if isinstance(x, str) else show(x)
    if isinstance(t, DoubleType):
        return float(x)
    if isinstance(t, DecimalType):
        return Decimal(x)
    if isinstance(t, ArrayType):
        return [encoded(i, t.elementType) for i in uncons(x)]
    if isinstance(t, MapType):
        return {encoded(k, t.keyType): encoded(v, t.valueType) for k, v in x.items()}
    if isinstance(t, StructType):
        return (x.name, *(encoded(a, f.dataType) for a, f in zip(x.args, t.fields[1:], strict=True)))
    return x


__all__ = ["AGGREGATORS", "Answer", "Functor", "ObjectHandle", "Opaque", "Session", "parse_expression"]
