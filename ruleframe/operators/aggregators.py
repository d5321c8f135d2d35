"""The aggregators: combined value by value, and as DataFrame aggregates.

Order never matters: where several results would do, the choice is fixed (the
least witness for ties of ``max=`` and ``min=``, sorted lists for
``concat_list=``, the largest value for ``merge_map=`` conflicts, the least
value for ``?=``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DataType, DecimalType, DoubleType, FloatType, IntegralType

from ruleframe.plans.terms import NULL, ConflictError, FrozenMap, Keyed, cons, same, show, uncons


@dataclass(frozen=True)
class Aggregator:
    """``fold`` turns (value, rule number) pairs of a key into its value.

    ``saturates`` is a value after which nothing can change; ``idempotent``
    aggregators may merge a delta into an old result.
    """

    name: str
    fold: Callable[[list[tuple[Any, int]]], Any]
    column: Callable[[Column, DataType], Column]
    saturates: Any = None
    idempotent: bool = False


ABSENT = object()


def _values(items: list[tuple[Any, int]]) -> list[Any]:
    return [v.value if isinstance(v, Keyed) else v for v, _ in items]


def _sum(items: list[tuple[Any, int]]) -> Any:
    return sum(_values(items))


def _product(items: list[tuple[Any, int]]) -> Any:
    out: Any = 1
    for v in _values(items):
        out *= v
    return out


def _unique(items: list[tuple[Any, int]]) -> Any:
    first = items[0][0]
    if any(not same(first, v) for v, _ in items):
        raise ConflictError(f"= has several values: {', '.join(sorted({show(v) for v, _ in items}))}")
    return first


def _extreme(better: Callable[[Any, Any], bool]):
    def fold(items: list[tuple[Any, int]]) -> Any:
        best: Any = ABSENT
        for v, _ in items:
            value, key = (v.value, show(v.key)) if isinstance(v, Keyed) else (v, "")
            if best is ABSENT or better(value, best[0]) or (value == best[0] and key < best[1]):
                best = (value, key, v)
        return best[2]

    return fold


def _last(items: list[tuple[Any, int]]) -> Any:
    number = max(n for _, n in items)
    found = _unique([x for x in items if x[1] == number])
    return ABSENT if same(found, NULL) else found


def _least(items: list[tuple[Any, int]]) -> Any:
    values = [v for v, _ in items]
    numbers = all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values)
    return min(values) if numbers else min(values, key=show)


def _mean(items: list[tuple[Any, int]]) -> Any:
    values = _values(items)
    total = sum(values)
    return total // len(values) if isinstance(total, int) and total % len(values) == 0 else total / len(values)


def _lists(items: list[tuple[Any, int]]) -> Any:
    return cons(x for v in sorted(_values(items), key=show) for x in uncons(v))


def _maps(items: list[tuple[Any, int]]) -> Any:
    out: dict = {}
    for m in _values(items):
        for k, v in m.items():
            out[k] = max(out[k], v, key=show) if k in out else v
    return FrozenMap(out)


def _sum_column(v: Column, t: DataType) -> Column:
    """Whole numbers are summed without overflow, to up to 38 digits.

    64-bit values are summed as three parts of 21 bits (the first with the
    sign), so each sum stays in 64 bits for up to 2 ** 41 rows of a group.
    """
    if isinstance(t, DecimalType):
        return F.sum(v.cast("decimal(38,0)") if t.scale == 0 else v)
    if not isinstance(t, IntegralType):
        return F.sum(v)
    v, mask = v.cast("bigint"), F.lit((1 << 21) - 1).cast("bigint")
    parts = (F.shiftright(v, 42), F.shiftright(v, 21).bitwiseAND(mask), v.bitwiseAND(mask))
    high, middle, low = (F.sum(p).cast("decimal(38,0)") for p in parts)
    return (high * F.lit(1 << 42) + middle * F.lit(1 << 21) + low).cast("decimal(38,0)")


def _product_column(v: Column, t: DataType) -> Column:
    """Exact for whole numbers, to up to 38 digits: a fold over the values that
    are neither 0, 1 nor -1, of which such a product has at most 126.  Doubles
    use the built-in product."""
    if isinstance(t, (DoubleType, FloatType)):
        return F.product(v)
    wide = v.cast("decimal(38,0)")
    factors = F.aggregate(F.collect_list(F.when(F.abs(wide) > 1, wide)), F.lit(1).cast("decimal(38,0)"), lambda a, x: (a * x).cast("decimal(38,0)"))
    sign = F.when(F.count(F.when(wide == -1, 1)) % 2 == 1, -1).otherwise(1)
    return F.when(F.count(F.when(wide == 0, 1)) > 0, F.lit(0)).otherwise(factors * sign).cast("decimal(38,0)")


def _unique_column(v: Column, t: DataType) -> Column:
    """The one value; comparing two extremes finds conflicts without a second
    shuffle of distinct values."""
    if "map<" in t.simpleString():
        form = F.to_json(F.array_sort(F.map_entries(v))) if t.simpleString().startswith("map<") else F.to_json(v)
        return F.when(F.min(form) == F.max(form), F.any_value(v)).otherwise(F.raise_error(F.lit("= has several values")).cast(t))
    return F.when(F.min(v) == F.max(v), F.min(v)).otherwise(F.raise_error(F.lit("= has several values")).cast(t))


AGGREGATORS: dict[str, Aggregator] = {
    a.name: a
    for a in (
        Aggregator("+=", _sum, _sum_column),
        Aggregator("*=", _product, _product_column),
        Aggregator("=", _unique, _unique_column),
        Aggregator("max=", _extreme(lambda a, b: a > b), lambda v, t: F.max(v), idempotent=True),
        Aggregator("min=", _extreme(lambda a, b: a < b), lambda v, t: F.min(v), idempotent=True),
        Aggregator(":-", lambda items: True, lambda v, t: F.lit(True), True, True),
        Aggregator("|=", lambda items: any(v is True for v in _values(items)), lambda v, t: F.bool_or(v), True, True),
        Aggregator("&=", lambda items: all(v is True for v in _values(items)), lambda v, t: F.bool_and(v), False, True),
        Aggregator(":=", _last, lambda v, t: v),
        Aggregator("?=", _least, lambda v, t: F.min(v), idempotent=True),
        Aggregator("concat_list=", _lists, lambda v, t: F.flatten(F.array_sort(F.collect_list(v)))),
        Aggregator("merge_map=", _maps, lambda v, t: v),
        Aggregator("mean=", _mean, lambda v, t: F.avg(v)),
    )
}
