"""What a query text means, before names are resolved."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


class CypherError(ValueError):
    """A query that can't be read or bound."""


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Param:
    name: str


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Prop:
    var: str
    key: str


@dataclass(frozen=True)
class Func:
    name: str
    args: tuple


@dataclass(frozen=True)
class Compare:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Logic:
    """``op`` is AND, OR or NOT."""

    op: str
    args: tuple


@dataclass(frozen=True)
class NodePattern:
    var: str | None = None
    labels: tuple[str, ...] = ()
    props: tuple[tuple[str, Any], ...] = ()


@dataclass(frozen=True)
class RelPattern:
    """``direction`` is out, in or both; ``hops`` is None for one hop, else (least, most or None)."""

    var: str | None = None
    label: str | None = None
    direction: str = "out"
    hops: tuple[int, int | None] | None = None


@dataclass(frozen=True)
class Pattern:
    nodes: tuple[NodePattern, ...]
    rels: tuple[RelPattern, ...] = ()


@dataclass(frozen=True)
class Item:
    expr: Any
    alias: str | None = None

    @property
    def name(self) -> str:
        return self.alias or written(self.expr)


@dataclass(frozen=True)
class Assignment:
    var: str
    key: str
    expr: Any


@dataclass(frozen=True)
class Query:
    kind: str  # match, create, merge
    mode: str = ""  # EXPLAIN, PROFILE
    patterns: tuple[Pattern, ...] = ()
    where: Any = None
    optional: Pattern | None = None
    optional_where: Any = None
    sets: tuple[Assignment, ...] = ()
    on_create: tuple[Assignment, ...] = ()
    on_match: tuple[Assignment, ...] = ()
    deletes: tuple[str, ...] = ()
    items: tuple[Item, ...] = ()
    order: tuple[tuple[Any, bool], ...] = field(default=())  # (expression, descending)
    skip: int | None = None
    limit: int | None = None


def written(expr: Any) -> str:
    """A column's name where the query gives no alias."""
    match expr:
        case Var(name):
            return name
        case Prop(var, key):
            return f"{var}.{key}"
        case Func(name, args):
            return f"{name}({', '.join(map(written, args))})"
    return "expr"


def shown(expr: Any) -> str:
    """An expression as a plan shows it."""
    match expr:
        case Lit(value):
            return repr(value) if isinstance(value, str) else {None: "NULL", True: "TRUE", False: "FALSE"}.get(value, str(value)) if value is None or isinstance(value, bool) else str(value)
        case Param(name):
            return f"${name}"
        case Compare(op, left, right):
            return f"{shown(left)} {op} {shown(right)}"
        case Logic("NOT", (x,)):
            return f"NOT {shown(x)}"
        case Logic(op, args):
            return f" {op} ".join(map(shown, args))
    return written(expr)
