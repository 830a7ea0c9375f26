"""Edges and neighbours of given nodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcloom.model import BOTH, IN, OUT, Graph
from arcloom.operators.sized import absent, among, dealt, parts


def incident(graph: Graph, node: int | DataFrame, direction: str = OUT, label: str | None = None) -> DataFrame:
    """``node, other, side`` and the edge's columns, for one node or for those in column ``id`` of a frame. Under ``both``
    out edges (side 0) come beside in edges (side 1), so a self-loop is there twice."""
    edges = graph.edges(label)
    sides = [("src", "dst", 0)] * (direction in (OUT, BOTH)) + [("dst", "src", 1)] * (direction in (IN, BOTH))
    views = [edges.select(F.col(a).alias("node"), F.col(b).alias("other"), F.lit(k).alias("side"), *edges.columns) for a, b, k in sides]
    out = reduce(DataFrame.unionAll, views)
    if isinstance(node, DataFrame):
        return out.join(node.select(F.col("id").alias("node")).distinct(), "node", "left_semi")
    return out.where(F.col("node") == node)


def edges_of(graph: Graph, node: int | DataFrame, direction: str = OUT, label: str | None = None) -> DataFrame:
    return incident(graph, node, direction, label).drop("node", "other").orderBy("side", "id")


def neighbors(graph: Graph, node: int | DataFrame, direction: str = OUT, label: str | None = None, distinct: bool | None = None) -> DataFrame:
    """``node`` and its neighbours' columns. Without a label each neighbour comes once; with one, once for each edge."""
    ends = incident(graph, node, direction, label).select("node", F.col("other").alias("id"))
    ends = ends.distinct() if (label is None if distinct is None else distinct) else ends
    return ends.join(graph.nodes(), "id")


def has_edge(graph: Graph, src: int, dst: int, label: str | None = None) -> bool:
    return not graph.edges(label, ()).where((F.col("src") == src) & (F.col("dst") == dst)).limit(1).isEmpty()


def having_edge(graph: Graph, pairs: DataFrame, label: str | None = None) -> DataFrame:
    """The rows of ``pairs`` (with ``src, dst``) that an edge joins: a semi-join, exact, in as many tasks as its tables' size asks for."""
    edges = graph.edges(label, ()).select("src", "dst")
    n = parts(pairs, edges)
    return dealt(pairs, "src", "dst", n=n).join(dealt(edges, "src", "dst", n=n), ["src", "dst"], "left_semi")


def degree(graph: Graph, direction: str = OUT, label: str | None = None) -> DataFrame:
    """``id, degree`` of every node, 0 included; a self-loop counts twice under ``both``."""
    edges = graph.edges(label, ())
    ends = reduce(DataFrame.unionAll, [edges.select(F.col(c).alias("id")) for c in (["src"] if direction == OUT else ["dst"] if direction == IN else ["src", "dst"])])
    counts = ends.groupBy("id").agg(F.count("*").alias("degree"))
    return graph.nodes(columns=()).select("id").join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def neighborhood(graph: Graph, node: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges around a node: itself, its edges of either direction, and their other ends (a bare id, if there is no such node)."""
    edges = graph.edges().where((F.col("src") == node) | (F.col("dst") == node))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).unionAll(graph.spark.range(node, node + 1)).distinct()
    return ends.join(graph.nodes(), "id", "left"), edges


def subgraph(graph: Graph, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of column ``id`` and the edges with both ends among them."""
    ids = ids.select("id").distinct()
    edges = graph.edges().join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    return graph.nodes().join(ids, "id", "left_semi"), edges


def display_label(columns: list[str]) -> Column:
    """The first of a node's name, title, label and username."""
    there = [F.col(f"`{c}`").cast("string") for c in ("name", "title", "label", "username") if c in columns]
    return F.coalesce(*there, F.col("id").cast("string"))


def dangling_edges(graph: Graph) -> DataFrame:
    """Edges of which an end doesn't exist. The missing ends are found first; mostly there is none, and then no edge is looked at again."""
    edges = graph.edges(columns=())
    ends = edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id")))
    missing = absent(ends, graph.nodes(columns=()))
    if missing.isEmpty():
        return graph.spark.createDataFrame([], edges.schema)
    open_ends = edges.where("src IS NULL OR dst IS NULL")
    by_end = [among(edges, end, missing).select(edges.columns) for end in ("src", "dst")]
    return reduce(DataFrame.unionAll, by_end, open_ends).distinct()


def verify(graph: Graph) -> DataFrame:
    """``check_name, violations``: ids that repeat, and edges with missing ends."""
    nodes, edges = graph.nodes(columns=()).select("id"), graph.edges(columns=()).select("id")
    repeats = lambda df: dealt(df, "id").groupBy("id").count().where("count > 1").agg(F.count("*").alias("violations"))
    rows = [("repeated node ids", repeats(nodes)), ("repeated edge ids", repeats(edges)), ("dangling edges", dangling_edges(graph).agg(F.count("*").alias("violations")))]
    return reduce(DataFrame.unionAll, [df.select(F.lit(name).alias("check_name"), "violations") for name, df in rows])


def checksums(graph: Graph) -> DataFrame:
    """``kind, label, n, checksum`` of each table: the number of its rows and the sum of a 64-bit hash of each, whatever their order and files."""

    def one(kind: str, label: str, df: DataFrame) -> DataFrame:
        hashed = df.select(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)").alias("h"))
        return hashed.agg(F.count("*").alias("n"), F.coalesce(F.sum("h"), F.lit(0)).cast("string").alias("checksum")).select(F.lit(kind).alias("kind"), F.lit(label).alias("label"), "n", "checksum")

    tables = [one("node", ":".join(k), df) for k, df in graph.node_tables.items()] + [one("edge", k, df) for k, df in graph.edge_tables.items()]
    return reduce(DataFrame.unionAll, tables) if tables else graph.spark.createDataFrame([], "kind string, label string, n bigint, checksum string")
