"""Breadth-first and depth-first traversal."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcloom.model import BOTH, IN, OUT, Graph
from arcloom.operators.sized import among, follow, with_ends
from arcloom.scratch import cut


def steps(edges: DataFrame, direction: str) -> DataFrame:
    """Edges as ``near, far, side, edge``: out edges (side 0) come before in edges (side 1), each by edge id."""
    out = edges.select(F.col("src").alias("near"), F.col("dst").alias("far"), F.lit(0).alias("side"), F.col("id").alias("edge"))
    back = edges.select(F.col("dst").alias("near"), F.col("src").alias("far"), F.lit(1).alias("side"), F.col("id").alias("edge"))
    return out if direction == OUT else back if direction == IN else out.unionAll(back)


def reach(edges: DataFrame, starts: DataFrame, most: int, direction: str = OUT) -> DataFrame:
    """``start, id, depth`` of every node within ``most`` hops (negative: any number) of every start, at its shortest depth.

    A level is one join of the frontier with the edges, a ``distinct`` and an anti-join with what was seen; it is written
    to the shared folder, as are the links once if there may be several levels. The driver only counts the frontier.
    """
    links = steps(edges, direction).select("near", "far")
    return _levels(links if 0 <= most <= 1 else cut(links), starts, most)


def _levels(links: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    seen = cut(starts.select("start", F.col("start").alias("id"), F.lit(0).alias("depth")).distinct())
    frontier, depth = seen, 0
    while (most < 0 or depth < most) and (rows := frontier.count()):
        depth += 1
        met = follow(frontier, links, rows).select("start", F.col("far").alias("id")).distinct()
        frontier = cut(met.join(seen.select("start", "id"), ["start", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionAll(frontier)
    return seen


def bfs(graph: Graph, start: int | list[int], max_depth: int = -1, direction: str = OUT, edge_filter: Column | None = None, labels: list[str] | None = None, node_filter: Column | None = None) -> DataFrame:
    """``start, id, depth, path`` in breadth-first order ``(depth, keys)``; ``path`` holds the edge ids from the start.

    The first path found to a node is, among its shortest, the least sequence of edges, out edges before in edges and then by id, so a ``min``
    over paths per level gives what a queue would. ``edge_filter`` (over an edge's columns) prunes; ``node_filter`` (over a node's)
    only chooses what is returned. Edges to nodes that don't exist lead nowhere; an unknown start raises.
    """
    starts = [start] if isinstance(start, int) else list(start)
    known = graph.nodes(columns=()).select("id")
    begin = known.where(F.col("id").isin(starts))
    if begin.count() != len(set(starts)):
        raise KeyError(f"no such node among {starts}")
    edges = graph.edges()
    if labels:
        edges = edges.where(F.col("label").isin(labels))
    if edge_filter is not None:
        edges = edges.where(edge_filter)
    links = with_ends(cut(steps(edges, direction)), known)
    hop = F.struct("side", "edge")
    none = F.array().cast("array<struct<side:int,edge:bigint>>")
    seen = cut(begin.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth"), none.alias("keys")))
    frontier, depth = seen, 0
    while (max_depth < 0 or depth < max_depth) and (rows := frontier.count()):
        depth += 1
        met = follow(frontier, links, rows).select("start", F.col("far").alias("id"), F.concat("keys", F.array(hop)).alias("keys"))
        best = met.groupBy("start", "id").agg(F.min("keys").alias("keys"))
        frontier = cut(best.join(seen.select("start", "id"), ["start", "id"], "left_anti").select("start", "id", F.lit(depth).alias("depth"), "keys"))
        seen = seen.unionAll(frontier)
    if node_filter is not None:
        seen = seen.join(graph.nodes().where(node_filter).select("id"), "id", "left_semi")
    return seen.select("start", "id", "depth", F.transform("keys", lambda k: k["edge"]).alias("path"), "keys").orderBy("start", "depth", "keys").drop("keys")


def dfs_order(adjacent: Callable[[int], list[tuple[int, int]]], start: int, max_depth: int = -1) -> list[tuple[int, int, list[int]]]:
    """``(node, depth, path)`` in the order in which a stack meets nodes: a node counts as visited, and is given out,
    when it is pushed, and edges are pushed last first. With a depth limit this isn't breadth-first reach."""
    out, seen, stack = [(start, 0, [])], {start}, [(start, 0, [])]
    while stack:
        node, depth, path = stack.pop()
        if 0 <= max_depth <= depth:
            continue
        for edge, target in reversed(adjacent(node)):
            if target not in seen:
                seen.add(target)
                hit = (target, depth + 1, [*path, edge])
                out.append(hit)
                stack.append(hit)
    return out


def dfs(graph: Graph, start: int, max_depth: int = -1, direction: str = OUT, edge_filter: Column | None = None, labels: list[str] | None = None, node_filter: Column | None = None, most_edges: int = 2_000_000) -> DataFrame:
    """``start, id, depth, path, seq`` in depth-first order.

    The order is sequential by nature, so the part of the graph within reach (found by ``reach``) is walked on the driver; if
    it has over ``most_edges`` edges this raises, and ``bfs`` is the scalable way.
    """
    known = graph.nodes(columns=()).select("id")
    begin = known.where(F.col("id") == start)
    if begin.isEmpty():
        raise KeyError(f"no such node: {start}")
    edges = graph.edges()
    if labels:
        edges = edges.where(F.col("label").isin(labels))
    if edge_filter is not None:
        edges = edges.where(edge_filter)
    links = cut(steps(edges, direction))
    near = cut(_levels(links, begin.select(F.col("id").alias("start")), max_depth).select("id").distinct())
    links = with_ends(cut(among(links, "near", near)), known)
    rows = links.select("near", "side", "edge", "far").limit(most_edges + 1).collect()
    if len(rows) > most_edges:
        raise RuntimeError(f"over {most_edges} edges are within reach; use bfs")
    adjacency = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["near"], r["side"], r["edge"])):
        adjacency[r["near"]].append((r["edge"], r["far"]))
    order = dfs_order(lambda n: adjacency[n], start, max_depth)
    out = graph.spark.createDataFrame([(start, n, d, p, i) for i, (n, d, p) in enumerate(order)], "start bigint, id bigint, depth int, path array<bigint>, seq int")
    if node_filter is not None:
        out = out.join(graph.nodes().where(node_filter).select("id"), "id", "left_semi").select("start", "id", "depth", "path", "seq")
    return out.orderBy("seq")
