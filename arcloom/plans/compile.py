"""From a query's tree to a DataFrame."""

from __future__ import annotations

import time
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcloom.functions.compare import compared, truth
from arcloom.model import IN, KEYS, OUT, Graph
from arcloom.plans.ast import Compare, CypherError, Func, Lit, Logic, NodePattern, Param, Pattern, Prop, Query, RelPattern, Var, shown
from arcloom.plans.parser import bind, params_of, parse

#: The most hops of a pattern without an upper bound.
MOST_HOPS = 50


@dataclass
class Step:
    """A node of the plan that users see; ``frame`` gives its rows."""

    name: str
    details: str = ""
    children: list["Step"] = field(default_factory=list)
    frame: DataFrame | None = None
    rows: int | None = None
    seconds: float | None = None

    def lines(self, prefix: str = "", last: bool = True, top: bool = True) -> list[str]:
        measured = f" [rows={self.rows}, time={self.seconds * 1000:.1f}ms]" if self.rows is not None else ""
        head = "" if top else prefix + ("└── " if last else "├── ")
        below = "" if top else prefix + ("    " if last else "│   ")
        out = [f"{head}{self.name}{f' ({self.details})' if self.details else ''}{measured}"]
        for i, child in enumerate(self.children):
            out += child.lines(below, i == len(self.children) - 1, False)
        return out


def _names(x: Any, found: dict[str, set]) -> None:
    """Which properties of each variable a tree needs; None among them: the whole entity."""
    match x:
        case Prop(var, key):
            found.setdefault(var, set()).add(key)
        case Var(name):
            found.setdefault(name, set()).add(None)
        case Func(_, args) | Logic(_, args):
            for a in args:
                if isinstance(a, Var) and isinstance(x, Func):
                    found.setdefault(a.name, set())
                else:
                    _names(a, found)
        case Compare(_, a, b):
            _names(a, found)
            _names(b, found)


class Binder:
    """The variables in scope. A variable ``v`` lives in columns ``v.id``, ``v.labels`` or ``v.label``, and ``v.<property>``."""

    def __init__(self, graph: Graph, query: Query):
        self.graph, self.query, self.kinds, self.fields, self.count = graph, query, {}, {}, 0
        self.needs: dict[str, set] = {}
        for x in [query.where, query.optional_where, *(i.expr for i in query.items), *(e for e, _ in query.order)]:
            _names(x, self.needs)
        for p in [*query.patterns, query.optional]:
            for n in p.nodes if p else ():
                if n.var:
                    self.needs.setdefault(n.var, set()).update(k for k, _ in n.props)
        for s in query.sets:
            self.needs.setdefault(s.var, set())

    def fresh(self) -> str:
        self.count += 1
        return f" {self.count}"

    def _columns(self, var: str) -> set[str] | None:
        need = self.needs.get(var, set())
        return None if None in need else {*need, KEYS}

    def column(self, var: str, name: str) -> Column:
        return F.col(f"`{var}.{name}`")

    def _prefixed(self, df: DataFrame, var: str, kind: str) -> DataFrame:
        self.kinds[var] = kind
        self.fields[var] = {f.name: f.dataType for f in df.schema}
        return df.select(*(F.col(f"`{c}`").alias(f"{var}.{c}") for c in df.columns))

    # patterns

    def node(self, p: NodePattern, var: str) -> DataFrame:
        """Nodes that match: labels choose the tables, inline properties must exist and be equal."""
        need = self._columns(var)
        wanted = None if need is None else need | {k for k, _ in p.props}
        df = self.graph.nodes(p.labels, wanted)
        for key, value in p.props:
            df = df.where(self._inline(df, key, value))
        return self._prefixed(df, var, "node")

    @staticmethod
    def _inline(df: DataFrame, key: str, value: Any) -> Column:
        if key not in df.columns:
            return F.lit(False)
        x = _literal(value)
        same = compared("=", F.col(f"`{key}`"), x[0], df.schema[key].dataType, x[1])
        return same & F.array_contains(KEYS, key) if KEYS in df.columns and value.value is None else same

    def edges(self, p: RelPattern, var: str, direction: str) -> DataFrame:
        """Edges as ``var.*`` with the ends ``near`` and ``far`` as seen in the pattern's direction."""
        df = self.graph.edges(p.label, self._columns(var))
        ends = [("src", "dst")] if direction == OUT else [("dst", "src")] if direction == IN else [("src", "dst"), ("dst", "src")]
        if p.var:
            self._prefixed(df, var, "edge")
        own = [F.col(f"`{c}`").alias(f"{var}.{c}") for c in df.columns] if p.var else []
        views = [df.select(F.col(a).alias(f"{var} near"), F.col(b).alias(f"{var} far"), *own) for a, b in ends]
        return reduce(DataFrame.unionAll, views)

    def hops(self, p: RelPattern, starts: DataFrame, start: str, var: str) -> DataFrame:
        """For each start the nodes at a shortest distance within the range."""
        from arcloom.operators.traversal import reach

        least, most = p.hops
        most = MOST_HOPS if most is None else most
        pairs = reach(self.graph.edges(p.label, ()), starts.select(self.column(start, "id").alias("start")).distinct(), most, p.direction)
        return pairs.where(F.col("depth") >= least).select(F.col("start").alias(f"{var} near"), F.col("id").alias(f"{var} far"))

    def pattern(self, p: Pattern, step: Step | None = None, bound: DataFrame | None = None) -> tuple[DataFrame, Step]:
        """Rows for every match of the chain; with ``bound``, the first node is that frame's."""
        first = p.nodes[0]
        start = first.var or self.fresh()
        if bound is None:
            df = self.node(first, start)
            step = _scan(self.graph, first, start, df)
        else:
            df = bound
        at = start
        for rel, node in zip(p.rels, p.nodes[1:], strict=True):
            r, n = rel.var or self.fresh(), node.var or self.fresh()
            if rel.hops and rel.var:
                raise CypherError(f"{rel.var}: a path of several hops has no single relationship to bind")
            if r in self.kinds:
                raise CypherError(f"{r} is bound twice")
            e = self.hops(rel, df, at, r) if rel.hops else self.edges(rel, r, rel.direction)
            df = df.join(e, F.col(f"`{at}.id`") == F.col(f"`{r} near`")).drop(f"{r} near")
            if n in self.kinds:
                df = df.where(F.col(f"`{r} far`") == self.column(n, "id")).drop(f"{r} far")
            else:
                b = self.node(node, n)
                df = df.join(b, F.col(f"`{r} far`") == F.col(f"`{n}.id`")).drop(f"{r} far")
            step = Step("VarLengthExpand" if rel.hops else "Expand(All)", _drawn(start if at == start else at, rel, node), [step], df)
            at = n
        return df, step

    # expressions

    def typed(self, x: Any) -> tuple[Column, T.DataType]:
        """An expression's column and type."""
        match x:
            case Lit():
                return _literal(x)
            case Prop(var, key):
                self._known(var)
                if self.kinds[var] == "edge" and key in ("label", "type"):
                    return self.column(var, "label"), T.StringType()
                kind = self.fields[var].get(key)
                if kind is None or key in ("id", "labels", KEYS, "src", "dst"):
                    return F.lit(None), T.NullType()
                return self.column(var, key), kind
            case Var(name):
                self._known(name)
                own = [c for c in self.fields[name] if c != KEYS]
                kind = T.StructType([T.StructField(c, self.fields[name][c]) for c in own])
                return F.when(self.column(name, "id").isNotNull(), F.struct(*(self.column(name, c).alias(c) for c in own))), kind
            case Func("type", (Var(name),)):
                self._known(name)
                return (self.column(name, "label") if self.kinds[name] == "edge" else F.lit(None).cast("string")), T.StringType()
            case Func("id", (Var(name),)):
                self._known(name)
                return self.column(name, "id"), T.LongType()
            case Func("type" | "id" as name, args):
                if len(args) != 1:
                    raise CypherError(f"{name}() takes one argument")
                return (F.lit(None).cast("string"), T.StringType()) if name == "type" else (F.lit(None).cast("bigint"), T.LongType())
            case Func(name, _):
                raise CypherError(f"no function {name}()")
            case Param(name):
                raise CypherError(f"parameter ${name} has no value")
        return self.condition(x), T.BooleanType()

    def _known(self, var: str) -> None:
        if var not in self.kinds:
            raise CypherError(f"{var} isn't bound")

    def condition(self, x: Any) -> Column:
        """A boolean that is never null."""
        match x:
            case Logic("NOT", (a,)):
                return ~self.condition(a)
            case Logic("AND", args):
                return reduce(Column.__and__, map(self.condition, args))
            case Logic("OR", args):
                return reduce(Column.__or__, map(self.condition, args))
            case Compare(op, left, right):
                if isinstance(left, Lit) and not isinstance(right, Lit):
                    op, left, right = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op), right, left
                (a, s), (b, t) = self.typed(left), self.typed(right)
                return compared(op, a, b, s, t, isinstance(right, Lit) and right.value is not None)
        return truth(*self.typed(x))


def _literal(x: Lit) -> tuple[Column, T.DataType]:
    v = x.value
    if isinstance(v, Column):
        raise CypherError("a column is no parameter")
    kind = T.NullType() if v is None else T.BooleanType() if isinstance(v, bool) else T.LongType() if isinstance(v, int) else T.DoubleType() if isinstance(v, float) else T.StringType()
    return (F.lit(None) if v is None else F.lit(v).cast(kind)), kind


def _scan(graph: Graph, p: NodePattern, var: str, df: DataFrame) -> Step:
    """Where a pattern's first nodes come from; a seek by index only if one is declared for a property of the pattern."""
    shown_var = var.strip() if p.var else ""
    label = f"{shown_var}:{':'.join(p.labels)}" if p.labels else shown_var
    step = Step("NodeByLabelScan" if p.labels else "AllNodesScan", label, [], df)
    if p.props:
        seek = any(set(keys) <= {k for k, _ in p.props} for keys in graph.indexes)
        step = Step("NodeIndexSeek" if seek else "Filter", ", ".join(f"{shown_var}.{k} = {shown(v)}" for k, v in p.props), [step], df)
    return step


def _drawn(at: str, rel: RelPattern, node: NodePattern) -> str:
    hops = "" if not rel.hops else f"*{rel.hops[0]}..{'' if rel.hops[1] is None else rel.hops[1]}"
    inner = f"[{rel.var or ''}{':' + rel.label if rel.label else ''}{hops}]"
    left, right = ("<-", "-") if rel.direction == IN else ("-", "->" if rel.direction == OUT else "-")
    return f"({at.strip() if not at.startswith(' ') else ''}){left}{inner}{right}({node.var or ''}{''.join(':' + x for x in node.labels)})"


def matched(graph: Graph, q: Query) -> tuple[DataFrame, Binder, Step]:
    """All bindings of a MATCH query, before it returns anything."""
    b = Binder(graph, q)
    df, step = b.pattern(q.patterns[0])
    if q.where is not None:
        df = df.where(b.condition(q.where))
        step = Step("Filter", shown(q.where), [step], df)
    if q.optional:
        df, step = _optional(b, q, df, step)
    return df, b, step


def _optional(b: Binder, q: Query, df: DataFrame, step: Step) -> tuple[DataFrame, Step]:
    """A left outer join: what the optional pattern and its WHERE ask for decides whether a match exists."""
    p, before = q.optional, set(b.kinds)
    first = p.nodes[0]
    taken = first.var in before
    if p.rels and not taken:
        raise CypherError("an optional path must start at a bound variable")
    if taken and p.rels:
        side, side_step = _optional_side(b, p, df)
        cond = F.col(f"`{first.var}.id`") == F.col("` near`")
        extra = _shared(b, p, before)
        if q.optional_where is not None:
            extra.append(b.condition(q.optional_where))
        out = df.join(side, reduce(Column.__and__, [cond, *extra]), "left").drop(" near", *(c for c in side.columns if c.startswith(" again")))
        return out, Step("OptionalExpand", _drawn(first.var, p.rels[0], p.nodes[1]), [step, side_step], out)
    if taken:
        return df, step
    side = b.node(first, first.var or b.fresh())
    cond = b.condition(q.optional_where) if q.optional_where is not None else F.lit(True)
    out = df.join(side, cond, "left")
    return out, Step("OptionalMatch", f"({first.var or ''}{''.join(':' + x for x in first.labels)})", [step], out)


def _optional_side(b: Binder, p: Pattern, df: DataFrame) -> tuple[DataFrame, Step]:
    side, step, at = None, None, p.nodes[0].var
    head = p.nodes[0]
    for i, (rel, node) in enumerate(zip(p.rels, p.nodes[1:], strict=True)):
        r = rel.var or b.fresh()
        if rel.hops and rel.var:
            raise CypherError(f"{rel.var}: a path of several hops has no single relationship to bind")
        source = df if side is None else side
        e = b.hops(rel, source, at, r) if rel.hops else b.edges(rel, r, rel.direction)
        if side is None:
            side = e.withColumnRenamed(f"{r} near", " near")
            if head.labels or head.props:
                own = b.graph.nodes(head.labels, {k for k, _ in head.props} | {KEYS})
                for key, value in head.props:
                    own = own.where(Binder._inline(own, key, value))
                side = side.join(own.select(F.col("id").alias(" head")), F.col("` near`") == F.col("` head`"), "left_semi")
        else:
            side = side.join(e, F.col(f"`{at}.id`") == F.col(f"`{r} near`")).drop(f"{r} near")
        again = node.var in b.kinds
        n = f" again{i}" if again else node.var or b.fresh()
        kept = (dict(b.kinds), dict(b.fields))
        target = b.node(NodePattern(n, node.labels, node.props), n)
        if again:
            b.kinds, b.fields = kept
            b.kinds.pop(n, None)
            target = target.select(F.col(f"`{n}.id`"))
        side = side.join(target, F.col(f"`{r} far`") == F.col(f"`{n}.id`")).drop(f"{r} far")
        step = Step("VarLengthExpand" if rel.hops else "Expand(All)", _drawn(at, rel, node), [step] if step else [], side)
        at = n
    return side, step


def _shared(b: Binder, p: Pattern, before: set[str]) -> list[Column]:
    """Where the optional path comes back to a variable that is bound already."""
    return [F.col(f"` again{i}.id`") == b.column(n.var, "id") for i, n in enumerate(p.nodes[1:]) if n.var in before]


def project(df: DataFrame, b: Binder, q: Query, step: Step) -> tuple[DataFrame, Step]:
    """ORDER BY (an alias first, then any binding; ties by the bindings' ids), SKIP, LIMIT and the returned columns."""
    if q.order:
        aliases = {i.alias: i.expr for i in q.items if i.alias}
        keys = []
        for expr, down in q.order:
            x = aliases.get(expr.name, expr) if isinstance(expr, Var) else expr
            column = b.typed(x)[0]
            if isinstance(x, Var):
                column = b.column(x.name, "id")
            keys.append(column.desc_nulls_last() if down else column.asc_nulls_first())
        df = df.orderBy(*keys, *(b.column(v, "id") for v in b.kinds))
        step = Step("Sort", ", ".join(shown(e) + (" DESC" if d else "") for e, d in q.order), [step], df)
    if q.skip:
        df = df.offset(q.skip)
        step = Step("Skip", str(q.skip), [step], df)
    if q.limit is not None:
        df = df.limit(q.limit)
        step = Step("Limit", str(q.limit), [step], df)
    names = [i.name for i in q.items]
    df = df.select(*(b.typed(i.expr)[0].alias(n) for i, n in zip(q.items, names, strict=True)))
    step = Step("Projection", ", ".join(shown(i.expr) for i in q.items), [step], df)
    return df, Step("ProduceResults", ", ".join(names), [step], df)


def prepared(text: str, params: Mapping[str, Any] | None) -> Query:
    q = parse(text)
    missing = params_of(q) - set(params or {})
    if missing:
        raise CypherError(f"no value for {', '.join('$' + x for x in sorted(missing))}")
    return bind(q, dict(params or {})) if params else q


def planned(graph: Graph, q: Query) -> tuple[DataFrame, Step]:
    if q.kind != "match" or q.sets or q.deletes:
        raise CypherError("this query changes data: run it on a store")
    df, b, step = matched(graph, q)
    return project(df, b, q, step)


def read(graph: Graph, text: str, params: Mapping[str, Any] | None = None) -> DataFrame:
    """The rows of a read query, lazily; for EXPLAIN and PROFILE the plan's lines, in a column ``plan``."""
    q = prepared(text, params)
    df, step = planned(graph, q)
    if not q.mode:
        return df
    if q.mode == "PROFILE":
        profile(step)
    return graph.spark.createDataFrame([(x,) for x in [f"{q.mode}:", *step.lines()]], "plan string")


def explain(graph: Graph, text: str, params: Mapping[str, Any] | None = None) -> str:
    q = prepared(text, params)
    return "\n".join(["EXPLAIN:", *planned(graph, q)[1].lines()])


def profile(step: Step) -> None:
    """Fill in rows and time of every step, each run by itself."""
    for child in step.children:
        profile(child)
    began = time.perf_counter()
    step.rows = step.frame.count()
    step.seconds = time.perf_counter() - began
