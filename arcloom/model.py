"""The graph: tables of nodes by label set and of edges by label."""

from __future__ import annotations

import contextlib
from collections import ChainMap
from collections.abc import Iterable, Iterator, Mapping
from functools import reduce
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OUT, IN, BOTH = "out", "in", "both"
#: Besides these, a table's columns are properties. ``_keys`` (optional) lists the keys that a row has, null values included.
NODE_COLUMNS, EDGE_COLUMNS, KEYS = ("id", "labels"), ("id", "src", "dst", "label"), "_keys"


def unify(frames: list[DataFrame]) -> DataFrame:
    """A union by name; a column that some lack is null there, and one of clashing types becomes text."""
    kinds: dict[str, set[str]] = {}
    for df in frames:
        for f in df.schema:
            kinds.setdefault(f.name, set()).add(f.dataType.simpleString())
    numbers = {"int", "bigint", "double", "float", "smallint", "tinyint"}
    clash = {c for c, k in kinds.items() if len(k - {"void"}) > 1 and not k <= numbers | {"void"}}
    frames = [df.withColumns({c: df[c].cast("string") for c in clash & set(df.columns)}) for df in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


class Graph:
    """Node tables keyed by their (sorted) label set, with ``id`` and properties; edge tables keyed by label, with
    ``id, src, dst`` and properties. A node is in one table, so nothing is read twice, and a label is a choice of tables:
    a pattern opens only the tables and reads only the columns that it needs. Either mapping may open its tables when they are asked for."""

    def __init__(self, spark: SparkSession, nodes: Mapping[tuple[str, ...] | str, DataFrame], edges: Mapping[str, DataFrame]):
        self.spark = spark
        if isinstance(nodes, dict):
            nodes = {(k,) if isinstance(k, str) else tuple(sorted(k)): df for k, df in nodes.items()}
        self.node_tables, self.edge_tables = nodes, edges
        self.indexes: set[tuple[str, ...]] = set()

    @classmethod
    def of_rows(cls, spark: SparkSession, nodes: Iterable[tuple], edges: Iterable[tuple]) -> "Graph":
        """From ``(id, labels, properties)`` and ``(id, src, dst, label, properties)``; for small graphs and tests."""
        groups: dict[tuple, list] = {}
        for i, labels, props in nodes:
            groups.setdefault(tuple(sorted(labels)), []).append(({"id": i}, props))
        rels: dict[str, list] = {}
        for i, src, dst, label, props in edges:
            rels.setdefault(label, []).append(({"id": i, "src": src, "dst": dst}, props))
        return cls(spark, {k: _frame(spark, x) for k, x in groups.items()}, {k: _frame(spark, x) for k, x in rels.items()})

    # reading

    def nodes(self, labels: Iterable[str] = (), columns: Iterable[str] | None = None) -> DataFrame:
        """Nodes that have all the labels: ``id, labels`` and the properties (only those in ``columns``, if given)."""
        wanted, want = set(labels), None if columns is None else set(columns)
        frames = []
        for key in self.node_tables:
            if wanted <= set(key):
                df = self.node_tables[key]
                own = [c for c in df.columns if c != "id" and (want is None or c in want)]
                frames.append(df.select("id", F.array(*map(F.lit, key)).cast("array<string>").alias("labels"), *own))
        if not frames:
            return self.spark.createDataFrame([], "id bigint, labels array<string>")
        return unify(frames)

    def edges(self, label: str | None = None, columns: Iterable[str] | None = None) -> DataFrame:
        """Edges of one label, or of all: ``id, src, dst, label`` and the properties (only those in ``columns``, if given)."""
        want = None if columns is None else set(columns)
        frames = []
        for key in self.edge_tables:
            if label is None or key == label:
                df = self.edge_tables[key]
                own = [c for c in df.columns if c not in ("id", "src", "dst") and (want is None or c in want)]
                frames.append(df.select("id", "src", "dst", F.lit(key).alias("label"), *own))
        if not frames:
            return self.spark.createDataFrame([], "id bigint, src bigint, dst bigint, label string")
        return unify(frames)

    def node(self, node_id: int) -> DataFrame:
        return self.nodes().where(F.col("id") == node_id)

    def edge(self, edge_id: int) -> DataFrame:
        return self.edges().where(F.col("id") == edge_id)

    def node_exists(self, node_id: int) -> bool:
        return not self.nodes(columns=()).where(F.col("id") == node_id).limit(1).isEmpty()

    def node_count(self) -> int:
        return sum(df.count() for df in self.node_tables.values())

    def edge_count(self) -> int:
        return sum(df.count() for df in self.edge_tables.values())

    def stats(self) -> DataFrame:
        """``kind, label, n``: how many nodes of each label set and edges of each label there are."""
        counts = [df.agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), F.lit(":".join(k)).alias("label"), "n") for k, df in self.node_tables.items()]
        counts += [df.agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), F.lit(k).alias("label"), "n") for k, df in self.edge_tables.items()]
        return reduce(DataFrame.unionAll, counts) if counts else self.spark.createDataFrame([], "kind string, label string, n bigint")

    def shard_stats(self, shards: int) -> DataFrame:
        """``shard, nodes, edges``: ids dealt by remainder; an edge lies with its source."""
        n = self.nodes(columns=()).groupBy(F.pmod("id", F.lit(shards)).alias("shard")).agg(F.count("*").alias("nodes"))
        e = self.edges(columns=()).groupBy(F.pmod("src", F.lit(shards)).alias("shard")).agg(F.count("*").alias("edges"))
        return n.join(e, "shard", "full").select("shard", F.coalesce("nodes", F.lit(0)).alias("nodes"), F.coalesce("edges", F.lit(0)).alias("edges"))

    # seeks

    def find(self, condition: Column) -> DataFrame:
        return self.nodes().where(condition)

    def find_by_label(self, label: str) -> DataFrame:
        return self.nodes((label,))

    def find_by_property(self, key: str, value: Any) -> DataFrame:
        df = self.nodes()
        return df.where(F.col(key).eqNullSafe(F.lit(value))) if key in df.columns else df.where(F.lit(False))

    def find_by_properties(self, values: Mapping[str, Any]) -> DataFrame:
        if len(values) < 2:
            raise ValueError("a composite seek needs two or more properties")
        df = self.nodes()
        if not set(values) <= set(df.columns):
            return df.where(F.lit(False))
        return df.where(reduce(Column.__and__, (F.col(k).eqNullSafe(F.lit(v)) for k, v in sorted(values.items()))))

    def find_unique(self, label: str, key: str, value: Any) -> DataFrame:
        df = self.nodes((label,))
        return (df.where(F.col(key) == F.lit(value)) if key in df.columns else df.where(F.lit(False))).limit(1)

    @contextlib.contextmanager
    def kept(self, *labels: str, edges: Iterable[str] = ()) -> Iterator["Graph"]:
        """The graph with the node tables that have one of the labels, and these edge tables, kept in executors' memory (what doesn't fit, on their disks) inside the block."""
        nodes = {k: self.node_tables[k].persist(StorageLevel.MEMORY_AND_DISK) for k in self.node_tables if set(k) & set(labels)}
        links = {k: self.edge_tables[k].persist(StorageLevel.MEMORY_AND_DISK) for k in edges}
        hot = Graph(self.spark, ChainMap(nodes, self.node_tables), ChainMap(links, self.edge_tables))
        hot.indexes = self.indexes
        try:
            yield hot
        finally:
            for df in (*nodes.values(), *links.values()):
                df.unpersist()

    # queries

    def cypher(self, text: str, params: Mapping[str, Any] | None = None) -> DataFrame:
        """Rows of a read query; see ``arcloom.plans.compile``."""
        from arcloom.plans.compile import read

        return read(self, text, params)

    def explain(self, text: str, params: Mapping[str, Any] | None = None) -> str:
        from arcloom.plans.compile import explain

        return explain(self, text, params)


def _frame(spark: SparkSession, rows: list[tuple[dict, dict]]) -> DataFrame:
    """Rows with a typed column for each property; values of clashing types become text."""
    keys: dict[str, set] = {}
    for _, props in rows:
        for k, v in props.items():
            keys.setdefault(k, set()).add(type(v))
    names = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}
    kinds = {}
    for k, seen in keys.items():
        seen -= {type(None)}
        kinds[k] = names[next(iter(seen))] if len(seen) == 1 and seen <= set(names) else T.DoubleType() if seen == {int, float} else T.StringType()
    fixed = list(rows[0][0])
    schema = T.StructType([T.StructField(c, T.LongType(), False) for c in fixed] + [T.StructField(k, t) for k, t in kinds.items()] + [T.StructField(KEYS, T.ArrayType(T.StringType()))])

    def cell(v: Any, t: T.DataType) -> Any:
        if v is None:
            return None
        return float(v) if isinstance(t, T.DoubleType) else str(v) if isinstance(t, T.StringType) else v

    return spark.createDataFrame([(*f.values(), *(cell(p.get(k), t) for k, t in kinds.items()), sorted(p)) for f, p in rows], schema)
