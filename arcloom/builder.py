"""Traversals as a chain of calls."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcloom.model import OUT, Graph
from arcloom.operators.traversal import bfs, dfs


@dataclass(frozen=True)
class Traversal:
    """``Traversal(graph).start(1).follow("knows").depth(2).rows()``; every call gives a new traversal."""

    graph: Graph
    origin: int | None = None
    labels: tuple[str, ...] = ()
    direction: str = OUT
    node_filter: Column | None = None
    edge_filter: Column | None = None
    max_depth: int = -1
    most: int = -1
    skip: int = 0
    depth_first: bool = False

    def start(self, node: int) -> "Traversal":
        return replace(self, origin=node)

    def follow(self, *labels: str) -> "Traversal":
        return replace(self, labels=self.labels + labels)

    def along(self, direction: str) -> "Traversal":
        return replace(self, direction=direction)

    def where(self, condition: Column) -> "Traversal":
        return replace(self, node_filter=condition if self.node_filter is None else self.node_filter & condition)

    def where_edge(self, condition: Column) -> "Traversal":
        return replace(self, edge_filter=condition if self.edge_filter is None else self.edge_filter & condition)

    def depth(self, n: int) -> "Traversal":
        return replace(self, max_depth=n)

    def limit(self, n: int) -> "Traversal":
        return replace(self, most=n)

    def offset(self, n: int) -> "Traversal":
        return replace(self, skip=n)

    def breadth_first(self) -> "Traversal":
        return replace(self, depth_first=False)

    def in_depth(self) -> "Traversal":
        return replace(self, depth_first=True)

    def rows(self) -> DataFrame:
        """``start, id, depth, path`` of the hits that pass the node filter, in order of the visit, after offset and limit."""
        if self.origin is None:
            raise ValueError("a traversal needs a start")
        walk = dfs if self.depth_first else bfs
        out = walk(self.graph, self.origin, self.max_depth, self.direction, self.edge_filter, list(self.labels), self.node_filter)
        out = out.offset(self.skip) if self.skip > 0 else out
        return (out.limit(self.most) if self.most >= 0 else out).select("start", "id", "depth", "path")

    def nodes(self) -> DataFrame:
        """The hits with their nodes' columns; a property named like a hit's column comes as ``node_`` and its name."""
        nodes = self.graph.nodes()
        nodes = nodes.withColumnsRenamed({c: f"node_{c}" for c in ("start", "depth", "path") if c in nodes.columns})
        return self.rows().join(nodes, "id").orderBy("depth", "path")


def together(jobs: Iterable[Traversal | Callable[[], Any]], workers: int = 8) -> list:
    """Results of several traversals (as lists of rows) or functions, in order; the first error is raised."""
    run = lambda j: j.rows().collect() if isinstance(j, Traversal) else j()
    with ThreadPoolExecutor(workers) as pool:
        return [f.result() for f in [pool.submit(run, j) for j in jobs]]


def text_of(column: str, default: str = "") -> Column:
    """A property as text, or the default."""
    return F.coalesce(F.col(column).cast("string"), F.lit(default))


def number_of(column: str, default: float = 0.0) -> Column:
    """A property as a number, or the default."""
    return F.coalesce(F.col(column).try_cast("double"), F.lit(default))
