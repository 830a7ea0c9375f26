"""Reading the query language."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import lru_cache
from typing import Any

from arcloom.plans.ast import Assignment, Compare, CypherError, Func, Item, Lit, Logic, NodePattern, Param, Pattern, Prop, Query, RelPattern, Var

# The language's reserved words.
KEYWORDS = frozenset("MATCH WHERE RETURN ORDER BY LIMIT AND OR NOT AS ASC DESC TRUE FALSE NULL TYPE EXPLAIN PROFILE OPTIONAL CREATE MERGE SET DELETE REMOVE ON SKIP".split())

_TOKEN = re.compile(
    r"""\s*(?:
      (?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")
    | (?P<float>\d+\.\d+)
    | (?P<int>\d+)
    | (?P<quoted>`[^`]+`)
    | (?P<word>[^\W\d]\w*)
    | \$(?P<param>[^\W\d]\w*)
    | (?P<sign><-|->|<>|<=|>=|\.\.|[()\[\]{}:,.=<>*-])
    )""",
    re.X | re.S,
)
_ESCAPES = {"\\": "\\", "'": "'", '"': '"', "n": "\n", "t": "\t"}


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise CypherError(f"can't read {text[at : at + 20].strip()!r} at position {at}")
        kind, part = m.lastgroup, m.group(m.lastgroup)
        if kind == "string":
            part = re.sub(r"\\(.)", lambda x: _ESCAPES.get(x[1], x[0]), part[1:-1], flags=re.S)
        elif kind == "quoted":
            kind, part = "name", part[1:-1]
        elif kind == "word":
            kind, part = ("key", part.upper()) if part.upper() in KEYWORDS else ("name", part)
        out.append(Token(kind, part, m.start(m.lastgroup)))
        at = m.end()
    return [*out, Token("end", "", len(text))]


class Parser:
    def __init__(self, text: str):
        self.tokens, self.at = tokens(text), 0

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def take(self, kind: str, text: str | None = None) -> Token | None:
        """The current token if it is this one; then it is passed."""
        t = self.now
        if t.kind == kind and (text is None or t.text == text):
            self.at += 1
            return t
        return None

    def need(self, kind: str, text: str | None = None) -> Token:
        got = self.take(kind, text)
        if not got:
            raise CypherError(f"expected {text or kind} at position {self.now.at}, found {self.now.text!r}")
        return got

    def key(self, *words: str) -> bool:
        """Whether these keywords come now; then they are passed."""
        ahead = self.tokens[self.at : self.at + len(words)]
        if [(t.kind, t.text) for t in ahead] != [("key", w) for w in words]:
            return False
        self.at += len(words)
        return True

    def listed(self, one) -> tuple:
        out = [one()]
        while self.take("sign", ","):
            out.append(one())
        return tuple(out)

    # queries

    def query(self) -> Query:
        if self.key("CREATE"):
            q = Query("create", patterns=self.listed(self.pattern))
            q = replace(q, items=self.listed(self.item) if self.key("RETURN") else ())
        elif self.key("MERGE"):
            q = self.merge()
        else:
            q = self.read()
        if self.now.kind != "end":
            raise CypherError(f"unexpected {self.now.text!r} at position {self.now.at}")
        return q

    def read(self) -> Query:
        mode = "EXPLAIN" if self.key("EXPLAIN") else "PROFILE" if self.key("PROFILE") else ""
        if not self.key("MATCH"):
            raise CypherError(f"expected MATCH, CREATE or MERGE at position {self.now.at}, found {self.now.text!r}")
        parts: dict[str, Any] = {"patterns": (self.pattern(),)}
        if self.key("WHERE"):
            parts["where"] = self.expression()
        if self.key("OPTIONAL", "MATCH"):
            parts["optional"] = self.pattern()
            if self.key("WHERE"):
                parts["optional_where"] = self.expression()
        if self.key("SET"):
            parts["sets"] = self.listed(self.assignment)
        if self.key("DELETE"):
            parts["deletes"] = self.listed(lambda: self.need("name").text)
        self.need("key", "RETURN")
        parts["items"] = self.listed(self.item)
        if self.key("ORDER", "BY"):
            parts["order"] = self.listed(self.sort_key)
        if self.key("SKIP"):
            parts["skip"] = int(self.need("int").text)
        if self.key("LIMIT"):
            parts["limit"] = int(self.need("int").text)
        return Query("match", mode, **parts)

    def merge(self) -> Query:
        node = self.node()
        if not node.labels:
            raise CypherError("MERGE needs a label")
        made: dict[str, tuple] = {"on_create": (), "on_match": ()}
        while self.key("ON"):
            which = "on_create" if self.key("CREATE") else "on_match"
            if which == "on_match":
                self.need("key", "MATCH")
            self.need("key", "SET")
            made[which] += self.listed(self.assignment)
        return Query("merge", patterns=(Pattern((node,)),), items=self.listed(self.item) if self.key("RETURN") else (), **made)

    # patterns

    def pattern(self) -> Pattern:
        nodes, rels = [self.node()], []
        while self.now.text in ("-", "<-") and self.now.kind == "sign":
            rels.append(self.rel())
            nodes.append(self.node())
        return Pattern(tuple(nodes), tuple(rels))

    def node(self) -> NodePattern:
        self.need("sign", "(")
        var, labels, props = self.take("name"), [], []
        while self.take("sign", ":"):
            labels.append(self.need("name").text)
        if self.take("sign", "{"):
            while not self.take("sign", "}"):
                name = self.need("name").text
                self.need("sign", ":")
                props.append((name, self.literal()))
                self.take("sign", ",")
        self.need("sign", ")")
        return NodePattern(var and var.text, tuple(labels), tuple(props))

    def rel(self) -> RelPattern:
        left = self.take("sign", "<-")
        if not left:
            self.need("sign", "-")
        self.need("sign", "[")
        var = self.take("name")
        label = self.need("name") if self.take("sign", ":") else None
        hops = None
        if self.take("sign", "*"):
            least = self.take("int")
            hops = (int(least.text) if least else 1, int(least.text) if least else None)
            if self.take("sign", ".."):
                most = self.take("int")
                hops = (hops[0], int(most.text) if most else None)
        self.need("sign", "]")
        if left:
            self.need("sign", "-")
            direction = "in"
        else:
            direction = "out" if self.take("sign", "->") else "both"
            if direction == "both":
                self.need("sign", "-")
        return RelPattern(var and var.text, label and label.text, direction, hops)

    # expressions

    def item(self) -> Item:
        expr = self.expression()
        return Item(expr, self.need("name").text if self.key("AS") else None)

    def sort_key(self) -> tuple[Any, bool]:
        expr = self.expression()
        down = self.key("DESC")
        if not down:
            self.key("ASC")
        return expr, down

    def assignment(self) -> Assignment:
        var = self.need("name").text
        self.need("sign", ".")
        name = self.need("name").text
        self.need("sign", "=")
        return Assignment(var, name, self.primary())

    def expression(self) -> Any:
        return self._chain("OR", lambda: self._chain("AND", self.negation))

    def _chain(self, word: str, one) -> Any:
        args = [one()]
        while self.key(word):
            args.append(one())
        return args[0] if len(args) == 1 else Logic(word, tuple(args))

    def negation(self) -> Any:
        if self.key("NOT"):
            return Logic("NOT", (self.negation(),))
        left = self.primary()
        for op in ("=", "<>", "<=", ">=", "<", ">"):
            if self.take("sign", op):
                return Compare(op, left, self.primary())
        return left

    def primary(self) -> Any:
        if self.now.kind in ("string", "int", "float", "param") or (self.now.kind == "key" and self.now.text in ("TRUE", "FALSE", "NULL")):
            return self.literal()
        named = self.take("name") or self.take("key", "TYPE")
        if not named:
            raise CypherError(f"expected an expression at position {self.now.at}, found {self.now.text!r}")
        name = named.text.lower() if named.kind == "key" else named.text
        if self.take("sign", "("):
            args = () if self.now.text == ")" else self.listed(self.expression)
            self.need("sign", ")")
            return Func(name.lower(), args)
        if named.kind == "key":
            raise CypherError(f"{named.text} is a reserved word (position {named.at})")
        return Prop(name, self.need("name").text) if self.take("sign", ".") else Var(name)

    def literal(self) -> Any:
        t = self.now
        self.at += 1
        match t.kind:
            case "string":
                return Lit(t.text)
            case "int":
                return Lit(int(t.text))
            case "float":
                return Lit(float(t.text))
            case "param":
                return Param(t.text)
            case "key" if t.text in ("TRUE", "FALSE", "NULL"):
                return Lit({"TRUE": True, "FALSE": False, "NULL": None}[t.text])
        raise CypherError(f"expected a literal at position {t.at}, found {t.text!r}")


@lru_cache(maxsize=10_000)
def parse(text: str) -> Query:
    """The query's tree. Trees are immutable, so one that is kept serves any parameters."""
    return Parser(text).query()


def params_of(x: Any) -> set[str]:
    """Names of the parameters anywhere in a tree."""
    if isinstance(x, Param):
        return {x.name}
    if isinstance(x, tuple):
        return set().union(*map(params_of, x)) if x else set()
    return set().union(*(params_of(getattr(x, f)) for f in x.__dataclass_fields__)) if hasattr(x, "__dataclass_fields__") else set()


def bind(x: Any, values: dict[str, Any]) -> Any:
    """A copy of the tree with the parameters' values in place."""
    if isinstance(x, Param):
        if x.name not in values:
            raise CypherError(f"parameter ${x.name} has no value")
        return Lit(values[x.name])
    if isinstance(x, tuple):
        return tuple(bind(y, values) for y in x)
    if hasattr(x, "__dataclass_fields__"):
        return replace(x, **{f: bind(getattr(x, f), values) for f in x.__dataclass_fields__})
    return x
