"""Paths between nodes, and orders of the whole graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from arcloom.model import OUT, Graph
from arcloom.operators.components import star_components
from arcloom.operators.sized import with_ends
from arcloom.operators.traversal import steps
from arcloom.scratch import cut, written

PATH = "src bigint, dst bigint, nodes array<bigint>, edges array<bigint>, hops int, cost double"


def shortest_path(graph: Graph, src: int, dst: int, label: str | None = None, direction: str = OUT) -> DataFrame:
    """One row ``src, dst, nodes, edges, hops, cost`` with the fewest edges (of equals, the least edge ids in turn); none, if there is no path."""
    links = cut(steps(graph.edges(label, ()), direction))
    frontier = graph.spark.range(src, src + 1).select("id", F.array("id").alias("nodes"), F.array().cast("array<struct<side:int,edge:bigint>>").alias("keys"))
    frontier = cut(frontier.join(graph.nodes(columns=()).select("id"), "id", "left_semi"))
    seen = frontier.select("id")
    while not frontier.isEmpty():
        hit = frontier.where(F.col("id") == dst)
        if not hit.isEmpty():
            hops = F.size("keys")
            return hit.select(F.lit(src).cast("bigint").alias("src"), F.lit(dst).cast("bigint").alias("dst"), "nodes", F.transform("keys", lambda k: k["edge"]).alias("edges"), hops.alias("hops"), hops.cast("double").alias("cost"))
        met = frontier.join(links, F.col("id") == F.col("near")).select(F.col("far").alias("id"), F.struct(F.concat("keys", F.array(F.struct("side", "edge"))).alias("keys"), F.concat("nodes", F.array("far")).alias("nodes")).alias("p"))
        best = met.groupBy("id").agg(F.min("p").alias("p"))
        frontier = cut(best.join(seen, "id", "left_anti").select("id", "p.nodes", "p.keys"))
        seen = seen.unionAll(frontier.select("id"))
    return graph.spark.createDataFrame([], PATH)


def has_path(graph: Graph, src: int, dst: int, label: str | None = None) -> bool:
    return not shortest_path(graph, src, dst, label).isEmpty()


def cheapest(graph: Graph, src: int, weight: str, default: float = 1.0, label: str | None = None, max_rounds: int = 10_000, dst: int | None = None) -> DataFrame:
    """``id, cost, edges, nodes`` of the cheapest path from ``src`` to every node it reaches, by rounds of relaxation.

    Edges without a number under ``weight`` cost ``default``; costs must not be negative. Of equally cheap paths the one of fewer
    edges counts, then the least edge ids. A round joins the nodes that became cheaper with the edges. With ``dst``, ways that
    already cost more than the cheapest one found to it aren't followed, so only its own row is sure to be the cheapest. Raises if costs still fall after ``max_rounds``.
    """
    edges = graph.edges(label)
    cost = F.coalesce(F.col(weight).try_cast("double"), F.lit(float(default))) if weight in edges.columns else F.lit(float(default))
    links = edges.select(F.col("src").alias("near"), F.col("dst").alias("far"), F.col("id").alias("edge"), cost.alias("w"))
    if not links.where("w < 0").limit(1).isEmpty():
        raise ValueError("weights must not be negative")
    links = with_ends(cut(links), graph.nodes(columns=()))
    empty = F.array().cast("array<bigint>")
    start = graph.nodes(columns=()).where(F.col("id") == src)
    best = cut(start.select("id", F.struct(F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), empty.alias("edges"), F.array("id").alias("nodes")).alias("p")))
    frontier = best
    for _ in range(max_rounds):
        if frontier.isEmpty():
            break
        offer = frontier.join(links, F.col("id") == F.col("near")).select(F.col("far").alias("id"), F.struct((F.col("p.cost") + F.col("w")).alias("cost"), (F.col("p.hops") + 1).alias("hops"), F.concat("p.edges", F.array("edge")).alias("edges"), F.concat("p.nodes", F.array("far")).alias("nodes")).alias("p"))
        offer = offer.groupBy("id").agg(F.min("p").alias("offer"))
        if dst is not None:
            reached = best.where(F.col("id") == dst).select("p.cost").first()
            offer = offer if reached is None else offer.where(F.col("offer.cost") <= reached[0])
        merged = cut(best.join(offer, "id", "full").select("id", F.least("p", "offer").alias("p"), (F.col("p").isNull() | (F.col("offer") < F.col("p"))).alias("_new")))
        frontier = merged.where("_new").select("id", "p")
        best = merged.select("id", "p")
    else:
        raise RuntimeError(f"costs still fall after {max_rounds} rounds")
    return best.select("id", "p.cost", "p.edges", "p.nodes")


def shortest_path_weighted(graph: Graph, src: int, dst: int, weight: str = "weight", default: float = 1.0, label: str | None = None) -> DataFrame:
    """One row as ``shortest_path`` gives it, of least cost; ``cost`` is the path's true cost and ``hops`` its number of edges."""
    found = cheapest(graph, src, weight, default, label, dst=dst).where(F.col("id") == dst)
    return found.select(F.lit(src).cast("bigint").alias("src"), F.lit(dst).cast("bigint").alias("dst"), "nodes", "edges", F.size("edges").alias("hops"), "cost")


def all_paths(graph: Graph, src: int, dst: int, max_depth: int = 10, label: str | None = None, keep: Column | None = None) -> DataFrame:
    """Every path without a repeated node of at most ``max_depth`` edges (0 or less: 10); parallel edges make different paths."""
    max_depth = max_depth if max_depth > 0 else 10
    links = graph.edges(label, ()).select(F.col("src").alias("near"), F.col("dst").alias("far"), F.col("id").alias("edge"))
    now = graph.nodes(columns=()).where(F.col("id") == src).select("id", F.array("id").alias("nodes"), F.array().cast("array<bigint>").alias("edges"))
    found = []
    if src == dst:
        found.append(now)
    for _ in range(max_depth if src != dst else 0):
        now = cut(now.join(links, F.col("id") == F.col("near")).where(~F.array_contains("nodes", F.col("far"))).select(F.col("far").alias("id"), F.concat("nodes", F.array("far")).alias("nodes"), F.concat("edges", F.array("edge")).alias("edges")))
        if now.isEmpty():
            break
        found.append(now.where(F.col("id") == dst))
        now = now.where(F.col("id") != dst)
    if not found:
        return graph.spark.createDataFrame([], PATH)
    out = found[0]
    for df in found[1:]:
        out = out.unionAll(df)
    return out.select(F.lit(src).cast("bigint").alias("src"), F.lit(dst).cast("bigint").alias("dst"), "nodes", "edges", F.size("edges").alias("hops"), F.size("edges").cast("double").alias("cost"))


def connected_components(graph: Graph, label: str | None = None) -> DataFrame:
    """``id, component`` of every node, isolated ones included; a component is named by its smallest id."""
    roots = star_components(graph.edges(label, ()))
    nodes = graph.nodes(columns=()).select("id")
    return nodes.join(roots, nodes["id"] == roots["node"], "left").select("id", F.coalesce("root", "id").alias("component"))


class CycleError(ValueError):
    pass


def topological_levels(graph: Graph, label: str | None = None) -> DataFrame:
    """``id, level`` of every node: the most edges on a path that ends there, so that every edge leads to a higher level.

    Levels are peeled: a node leaves when its last incoming edge has gone. A level is one job, whose result, what is left and what is ready, is
    written once and read by the next level and in the end. Raises ``CycleError`` on a cycle; a self-loop is one.
    Ends of edges that aren't nodes are ordered like nodes.
    """
    edges = cut(graph.edges(label, ()).select("src", "dst"))
    ids = graph.nodes(columns=()).select("id").unionAll(edges.select("src")).unionAll(edges.select("dst")).distinct()
    waiting = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("open"))
    left = ids.join(waiting, "id", "left").select("id", F.coalesce("open", F.lit(0)).alias("open"), F.lit(0).alias("level"))
    parts, kinds = [], left.schema
    while True:
        seen = Observation()
        parts.append(written(left.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(F.col("open") == 0).alias("ready"))))
        n, ready = seen.get["n"], seen.get["ready"]
        if n and not ready:
            raise CycleError("the graph has a cycle")
        if n == ready:
            break
        now = graph.spark.read.schema(kinds).parquet(parts[-1])
        done = now.where("open = 0").select(F.col("id").alias("src"))
        gone = edges.join(done, "src", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("closed"))
        left = now.where("open > 0").join(gone, "id", "left").select("id", (F.col("open") - F.coalesce("closed", F.lit(0))).alias("open"), (F.col("level") + 1).alias("level"))
    return graph.spark.read.schema(kinds).parquet(*parts).where("open = 0").select("id", "level")


def topological_sort(graph: Graph, label: str | None = None) -> DataFrame:
    return topological_levels(graph, label).orderBy("level", "id")
