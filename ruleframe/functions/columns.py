"""Builtin functions as columns: which arguments must be known for which result.

Each function has modes ``(known, solved, build)``: positions of the arguments
(the result comes last) that must be known, the position that follows, and the
column for it.  A row whose column is null has no value and is dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

Mode = tuple[tuple[int, ...], int, Callable[..., Column]]
MODES: dict[tuple[str, int], list[Mode]] = {}

#: Comparisons: with result true they filter.
TESTS: dict[str, Callable[[Column, Column], Column]] = {
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "==": lambda a, b: a.eqNullSafe(b),
    "!=": lambda a, b: ~a.eqNullSafe(b),
}


def _two(name: str, forward: Callable, left: Callable, right: Callable) -> None:
    MODES[name, 2] = [((0, 1), 2, forward), ((1, 2), 0, left), ((0, 2), 1, right)]


def _one(name: str, forward: Callable, back: Callable | None = None) -> None:
    MODES[name, 1] = [((0,), 1, forward)] + ([((1,), 0, back)] if back else [])


def _divide(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def hash_unit(key: Column, seed: int) -> Column:
    """The number in [0, 1) that the evaluator over values gives the key."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def _positive(x: Column, value: Column) -> Column:
    return F.when(x > 0, value)


_two("+", lambda a, b: a + b, lambda b, c: c - b, lambda a, c: c - a)
_two("-", lambda a, b: a - b, lambda b, c: c + b, lambda a, c: a - c)
_two("*", lambda a, b: a * b, lambda b, c: _divide(c, b), lambda a, c: _divide(c, a))
_two("/", _divide, lambda b, c: c * b, lambda a, c: _divide(a, c))
for _n in ("pow", "**"):
    _two(_n, lambda a, b: F.pow(a, b), lambda b, c: F.when((c > 0) & (b != 0), F.pow(c, F.lit(1.0) / b)), lambda a, c: F.when((a > 0) & (c > 0) & (a != 1), F.ln(c) / F.ln(a)))
MODES["min", 2] = [((0, 1), 2, lambda a, b: F.least(a, b))]
MODES["max", 2] = [((0, 1), 2, lambda a, b: F.greatest(a, b))]
_one("$neg", lambda a: -a, lambda b: -b)
_one("sqrt", lambda a: F.when(a >= 0, F.sqrt(a)), lambda b: b * b)
_one("exp", F.exp, lambda b: _positive(b, F.ln(b)))
_one("log", lambda a: _positive(a, F.ln(a)), F.exp)
for _f, _g in (("sin", "asin"), ("cos", "acos"), ("tan", "atan")):
    _one(_f, getattr(F, _f), getattr(F, _g))
    _one(_g, getattr(F, _g), getattr(F, _f))
for _f in ("sinh", "cosh", "tanh"):
    _one(_f, getattr(F, _f), getattr(F, "a" + _f))
    _one("a" + _f, getattr(F, "a" + _f), getattr(F, _f))
MODES["&&", 2] = [((0, 1), 2, lambda a, b: a & b)]
MODES["||", 2] = [((0, 1), 2, lambda a, b: a | b)]
_one("!", lambda a: ~a, lambda b: ~b)
for _n in range(1, 10):
    MODES["str", _n] = [(tuple(range(_n)), _n, lambda *a: F.concat(*[x.cast("string") for x in a]))]
_one("cast_int", lambda a: F.floor(F.expr("try_cast(1 as double)") * 0 + a.try_cast("double")).cast("bigint"))
_one("cast_float", lambda a: a.try_cast("double"))
MODES["$cons", 2] = [((0, 1), 2, lambda h, t: F.concat(F.array(h), t))]
_one("list_length", lambda a: F.size(a).cast("bigint"))
MODES["list_length", 2] = [((0,), 1, lambda a: F.size(a).cast("bigint"))]
MODES["append", 2] = [((0, 1), 2, lambda a, b: F.concat(a, b))]
_one("$map_keys", lambda a: F.array_sort(F.map_keys(a)))
_one("$map_values", lambda a: F.transform(F.array_sort(F.map_keys(a)), lambda k: F.element_at(a, k)))
_one("$value", lambda a: a)
