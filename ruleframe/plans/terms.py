"""Values and syntax trees of the rule language."""

from __future__ import annotations

from decimal import Decimal
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from typing import Any


class RuleError(Exception):
    """Base of the errors that a program can cause."""


class SyntaxProblem(RuleError):
    pass


class UnsafeRuleError(RuleError):
    """A variable stays free where a value is needed."""


class ConflictError(RuleError):
    """``=`` got different values for one key, or aggregators were mixed."""


class AssertionFailed(RuleError):
    pass


class SystemTermError(RuleError):
    """A program redefines a name that the system defines."""


@dataclass(frozen=True)
class Term:
    """A name with arguments: a structure value or a node of a syntax tree."""

    name: str
    args: tuple = ()

    def __len__(self) -> int:
        return len(self.args)

    def __getitem__(self, i: int) -> Any:
        return self.args[i]

    def __str__(self) -> str:
        return show(self)


NIL = Term("$nil")
NULL = Term("$null")


class FrozenMap(Mapping):
    """Immutable, hashable map value."""

    __slots__ = ("_items",)

    def __init__(self, items: Any = ()):
        self._items = dict(items)

    def __getitem__(self, k: Any) -> Any:
        return self._items[k]

    def __iter__(self) -> Iterator:
        return iter(self._items)

    def __len__(self) -> int:
        return len(self._items)

    def __hash__(self) -> int:
        return hash(frozenset(self._items.items()))

    def __eq__(self, other: Any) -> bool:
        return isinstance(other, FrozenMap) and self._items == other._items

    def without(self, k: Any) -> FrozenMap:
        return FrozenMap((a, b) for a, b in self._items.items() if a != k)

    def put(self, k: Any, v: Any) -> FrozenMap:
        return FrozenMap({**self._items, k: v})


@dataclass(frozen=True)
class Handle:
    """An object: the classes it is made of, with the values each captured."""

    classes: tuple[tuple[int, tuple], ...] = ()


@dataclass(frozen=True)
class Keyed:
    """A value with the witness that ``arg`` gave it."""

    value: Any
    key: Any


@dataclass(frozen=True)
class Opaque:
    """Any host value; compared by the host's own equality."""

    value: Any

    def __hash__(self) -> int:
        try:
            return hash(self.value)
        except TypeError:
            return id(self.value)


def cons(items: Any, tail: Any = NIL) -> Any:
    for x in reversed(list(items)):
        tail = Term(".", (x, tail))
    return tail


def is_list(value: Any) -> bool:
    while isinstance(value, Term) and value.name == "." and len(value) == 2:
        value = value.args[1]
    return value == NIL


def uncons(value: Any) -> list:
    out = []
    while isinstance(value, Term) and value.name == "." and len(value) == 2:
        out.append(value.args[0])
        value = value.args[1]
    return out


def to_value(x: Any) -> Any:
    """Host value to a value of the language."""
    if isinstance(x, (list, tuple)):
        return cons(map(to_value, x))
    if isinstance(x, dict):
        return FrozenMap((to_value(k), to_value(v)) for k, v in x.items())
    if isinstance(x, Decimal):
        return int(x) if x == x.to_integral_value() else float(x)
    if x is None or isinstance(x, (bool, int, float, str, Term, FrozenMap, Handle, Opaque)):
        return NULL if x is None else x
    return Opaque(x)


def to_host(x: Any) -> Any:
    if isinstance(x, Keyed):
        return to_host(x.value)
    if is_list(x):
        return [to_host(i) for i in uncons(x)]
    if isinstance(x, FrozenMap):
        return {to_host(k): to_host(v) for k, v in x.items()}
    if isinstance(x, Opaque):
        return x.value
    if isinstance(x, Term):
        return None if x == NULL else Term(x.name, tuple(map(to_host, x.args)))
    return x


def show(x: Any) -> str:
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, Term):
        if is_list(x):
            return "[" + ", ".join(show(i) for i in uncons(x)) + "]"
        return x.name + ("[" + ", ".join(show(a) for a in x.args) + "]" if x.args else "")
    if isinstance(x, FrozenMap):
        return "{" + ", ".join(f"{show(k)} -> {show(v)}" for k, v in x.items()) + "}"
    if isinstance(x, str):
        return f'"{x}"'
    if isinstance(x, Keyed):
        return show(x.value)
    return str(x)


def same(a: Any, b: Any) -> bool:
    """Equality by type: 1, 1.0 and true are three values."""
    if isinstance(a, Term) and isinstance(b, Term):
        return a.name == b.name and len(a) == len(b) and all(map(same, a.args, b.args))
    if isinstance(a, Keyed) or isinstance(b, Keyed):
        return same(a.value if isinstance(a, Keyed) else a, b.value if isinstance(b, Keyed) else b)
    kinds = (bool, float, str)
    if any(isinstance(a, k) != isinstance(b, k) for k in kinds):
        return False
    return a == b


def typed(x: Any) -> Any:
    """Form of a value that keeps types apart as a key."""
    if isinstance(x, Term):
        return (x.name, *map(typed, x.args))
    return (type(x).__name__ if isinstance(x, (bool, float)) else "", x)
