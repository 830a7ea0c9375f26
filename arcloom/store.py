"""A graph on disk in versions: every commit adds small tables of what changed and then moves one pointer."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Iterable, Mapping
from functools import reduce
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcloom.model import KEYS, Graph, _frame, unify
from arcloom.operators import constraints
from arcloom.plans.ast import CypherError, Lit, NodePattern, Query
from arcloom.plans.compile import Binder, matched, planned, prepared, project, read
from arcloom.scratch import cut


class ReadOnlyError(RuntimeError):
    """A write to a store that only follows another."""


class ConflictError(RuntimeError):
    """Another writer committed first."""


class QueueFull(RuntimeError):
    """As many writes as the store lets wait are waiting."""


#: Parts of a table beyond which a commit writes it anew as one.
MOST_PARTS = 24
ADDED, GONE = "+", "-"


@dataclass
class Stats:
    nodes_created: int = 0
    edges_created: int = 0
    labels_set: int = 0
    props_set: int = 0
    nodes_deleted: int = 0
    edges_deleted: int = 0


@dataclass
class Written:
    """What a writing query returns."""

    rows: DataFrame | None
    stats: Stats


@dataclass
class State:
    """The pointer's content: the parts of each table of this version, the change records up to it, and what is declared.

    A table (of nodes: its labels joined by ":") is a list of parts ``(ADDED, path of rows)`` and ``(GONE, path of ids)``, of which the
    latter take away rows of all parts before. ``logs`` lists ``(path, first, last)`` of the change records.
    """

    version: int = 0
    nodes: dict[str, list[list[str]]] = field(default_factory=dict)
    edges: dict[str, list[list[str]]] = field(default_factory=dict)
    logs: list[list] = field(default_factory=list)
    next_node: int = 1
    next_edge: int = 1
    lsn: int = 0
    indexes: list[list[str]] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)


class Files:
    """Small files through Hadoop's file system, so that any store Spark reads will do."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _fs(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def read(self, path: str) -> str | None:
        fs, p = self._fs(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Whether the file was made; False if there was one."""
        fs, p = self._fs(path)
        try:
            out = fs.create(p, False)
        except Exception as e:
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def age(self, path: str) -> float:
        """Seconds since the path was last changed."""
        fs, p = self._fs(path)
        return time.time() - fs.getFileStatus(p).getModificationTime() / 1000

    def size(self, path: str) -> int:
        fs, p = self._fs(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def remove(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)


def _key(labels: Iterable[str]) -> str:
    return ":".join(sorted(set(labels)))


def _labels(key: str) -> tuple[str, ...]:
    return tuple(x for x in key.split(":") if x)


def table_of(spark: SparkSession, parts: list) -> DataFrame:
    """The table that the parts make, in their order."""
    out, added = None, []
    for kind, path in parts:
        df = spark.read.parquet(path)
        if kind == ADDED:
            added.append(df)
        elif added or out is not None:
            out, added = unify([*([] if out is None else [out]), *added]), []
            out = out.join(df.select("id"), "id", "left_anti").select(*out.columns)
    return unify([*([] if out is None else [out]), *added])


class Tables(Mapping):
    """Tables by key, opened when first asked for."""

    def __init__(self, spark: SparkSession, parts: Mapping[Any, list]):
        self.spark, self.parts, self.open = spark, parts, {}

    def __getitem__(self, key: Any) -> DataFrame:
        if key not in self.open:
            self.open[key] = table_of(self.spark, self.parts[key])
        return self.open[key]

    def __iter__(self):
        return iter(self.parts)

    def __len__(self) -> int:
        return len(self.parts)


def _graph(spark: SparkSession, nodes: Mapping[str, list], edges: Mapping[str, list], indexes: Iterable = ()) -> Graph:
    g = Graph(spark, Tables(spark, {_labels(k): v for k, v in nodes.items() if v}), Tables(spark, {k: v for k, v in edges.items() if v}))
    g.indexes = {tuple(x) for x in indexes}
    return g


class Store:
    """A graph in ``path``: ``tables/`` holds Parquet, ``versions/`` a small file per commit, ``log/`` the change records.

    A write adds a small table of new or changed rows, and one of ids that are gone; nothing is rewritten until a table has ``MOST_PARTS``
    parts. A commit creates its version's file, which succeeds for one writer only: a second one that started from the same
    version gets ``ConflictError``, and as a version's file names its tables and change records, what it wrote is never read.
    Readers and snapshots keep to the version they opened. A commit checks the unique constraints for the values that it adds.
    Writes of one process take turns; at most ``queue`` may wait, beyond which ``QueueFull`` is raised.
    """

    def __init__(self, spark: SparkSession, path: str, read_only: bool = False, queue: int = 1000):
        self.spark, self.path, self.read_only = spark, path.rstrip("/"), read_only
        self.files, self.lock, self.waiting = Files(spark), threading.RLock(), threading.BoundedSemaphore(queue)
        if not self.versions():
            self.files.create(f"{self.path}/versions/{0:012d}.json", json.dumps(State().__dict__))

    # versions

    def versions(self) -> list[int]:
        return [int(x.split(".")[0]) for x in self.files.names(f"{self.path}/versions") if x.endswith(".json")]

    def state(self, version: int | None = None) -> State:
        at = max(self.versions()) if version is None else version
        text = self.files.read(f"{self.path}/versions/{at:012d}.json")
        if text is None:
            raise KeyError(f"no version {at}")
        return State(**json.loads(text))

    def graph(self, version: int | None = None) -> Graph:
        s = self.state(version)
        return _graph(self.spark, s.nodes, s.edges, s.indexes)

    def snapshot(self) -> "Snapshot":
        return Snapshot(self, self.state().version)

    def begin(self) -> "Tx":
        if self.read_only:
            raise ReadOnlyError("this store is read-only")
        return Tx(self, self.state())

    def commit(self, tx: "Tx") -> int:
        with self.lock:
            s = tx.state
            tx.merge_parts()
            after = State(s.version + 1, tx.parts["nodes"], tx.parts["edges"], list(s.logs), tx.next_node, tx.next_edge, s.lsn, tx.indexes, tx.unique)
            self._check(tx)
            log = None
            if tx.changes:
                rows = [(s.lsn + i + 1, after.version, time.time(), op, json.dumps(payload)) for i, (op, payload) in enumerate(tx.changes)]
                log = f"{self.path}/log/{after.version:012d}-{uuid.uuid4().hex}"
                self.spark.createDataFrame(rows, LOG).coalesce(1).write.parquet(log)
                after.logs.append([log, s.lsn + 1, s.lsn + len(rows)])
                after.lsn += len(rows)
            if not self.files.create(f"{self.path}/versions/{after.version:012d}.json", json.dumps(after.__dict__)):
                if log:
                    self.files.remove(log)
                raise ConflictError(f"version {after.version} was committed by another writer")
            return after.version

    def _check(self, tx: "Tx") -> None:
        """Unique constraints: new ones on all nodes of their label, old ones on the values that this transaction adds."""
        if not tx.unique:
            return
        g = tx.graph()
        for label, key in map(tuple, tx.unique):
            if [label, key] not in tx.state.unique:
                constraints.check(g, [(label, key)])
                continue
            added = [self.spark.read.parquet(path) for name, path in tx.added if label in _labels(name)]
            if added := [df for df in added if key in df.columns]:
                constraints.check(g, [(label, key)], unify([df.select(key) for df in added]))

    # one operation, one commit

    def _alone(self, f):
        if not self.waiting.acquire(blocking=False):
            raise QueueFull("too many writes are waiting")
        try:
            with self.lock:
                tx = self.begin()
                out = f(tx)
                tx.commit()
                return out
        finally:
            self.waiting.release()

    def add_node(self, props: Mapping[str, Any], labels: Iterable[str] = ()) -> int:
        return self._alone(lambda t: t.add_node(props, labels))

    def add_nodes(self, rows: list[Mapping[str, Any]], labels: Iterable[str] = ()) -> list[int]:
        return self._alone(lambda t: t.add_nodes(rows, labels))

    def add_edge(self, src: int, dst: int, label: str, props: Mapping[str, Any] = {}) -> int:
        return self._alone(lambda t: t.add_edge(src, dst, label, props))

    def add_edges(self, rows: list[tuple], check: bool = False) -> list[int]:
        return self._alone(lambda t: t.add_edges(rows, check))

    def update_node(self, node: int, props: Mapping[str, Any]) -> None:
        self._alone(lambda t: t.update_node(node, props))

    def set_node_props(self, node: int, props: Mapping[str, Any]) -> None:
        self._alone(lambda t: t.set_node_props(node, props))

    def delete_node(self, node: int) -> None:
        self._alone(lambda t: t.delete_nodes([node]))

    def add_label(self, node: int, *labels: str) -> None:
        self._alone(lambda t: t.relabel(node, add=labels))

    def remove_label(self, node: int, *labels: str) -> None:
        self._alone(lambda t: t.relabel(node, remove=labels))

    def update_edge(self, edge: int, props: Mapping[str, Any]) -> None:
        self._alone(lambda t: t.update_edge(edge, props))

    def delete_edge(self, edge: int) -> None:
        self._alone(lambda t: t.delete_edges([edge]))

    def load_nodes(self, df: DataFrame, labels: Iterable[str]) -> None:
        """Bulk load a frame that has ``id``."""
        self._alone(lambda t: t.load_nodes(df, labels))

    def load_edges(self, df: DataFrame, label: str, check: bool = False) -> None:
        self._alone(lambda t: t.load_edges(df, label, check))

    # declarations

    def create_index(self, *keys: str) -> None:
        """Declare an index: tables that have its keys are written anew, sorted by them and with Parquet's Bloom filters on each, so that a seek
        skips most files and row groups; what is added later is written so too. Results never depend on it."""
        self._alone(lambda t: t.declare(index=list(keys)))

    def drop_index(self, *keys: str) -> None:
        self._alone(lambda t: t.declare(drop_index=list(keys)))

    def reindex(self) -> None:
        self.compact()

    def indexes(self) -> list[tuple[str, ...]]:
        return [tuple(x) for x in self.state().indexes]

    def has_index(self, *keys: str) -> bool:
        return list(keys) in self.state().indexes

    def create_unique(self, label: str, key: str) -> None:
        self._alone(lambda t: t.declare(unique=[label, key]))

    def drop_unique(self, label: str, key: str) -> None:
        self._alone(lambda t: t.declare(drop_unique=[label, key]))

    def unique_constraints(self) -> list[tuple[str, str]]:
        return [tuple(x) for x in self.state().unique]

    def has_unique(self, label: str, key: str) -> bool:
        return [label, key] in self.state().unique

    # upkeep

    def compact(self, partitions: int | None = None) -> int:
        """Write every table anew as one part, sorted by the first index; returns bytes saved."""
        before = self._live_bytes()
        tx = self.begin()
        for kind in ("nodes", "edges"):
            for name in tx.names(kind):
                df = tx.table(kind, name)
                tx.put(kind, name, df.coalesce(partitions) if partitions else df)
        tx.commit()
        return before - self._live_bytes()

    def compact_every(self, seconds: float, stop: threading.Event, partitions: int | None = None, keep: int = 2) -> threading.Thread:
        """Compact and prune at intervals until ``stop`` is set; a commit that another writer wins is tried again the next time."""

        def run() -> None:
            while not stop.wait(seconds):
                try:
                    self.compact(partitions)
                    self.prune(keep)
                except ConflictError:
                    continue

        thread = threading.Thread(target=run, daemon=True)
        thread.start()
        return thread

    def _live_bytes(self) -> int:
        s = self.state()
        return sum(self.files.size(p) for p in _paths(s))

    def prune(self, keep: int = 1, unnamed_after: float = 3600.0) -> int:
        """Delete all but the last ``keep`` versions and the tables that only they use, and what no version names (of commits that failed)
        and is older than ``unnamed_after`` seconds; returns how many versions went. Change records stay until ``trim``."""
        versions = self.versions()
        old, live = versions[:-keep], versions[-keep:]
        states = [self.state(v) for v in live]
        used = {p for s in states for p in _paths(s)}
        bulk = {json.loads(r[0]).get("path") for r in self.changes().where("op IN ('load_nodes', 'load_edges', 'delete_nodes', 'delete_edges', 'set_many')").select("payload").toLocalIterator()}
        for v in old:
            for p in _paths(self.state(v)) - used - bulk:
                self.files.remove(p)
            self.files.remove(f"{self.path}/versions/{v:012d}.json")
        named = used | bulk | {x[0] for s in states for x in s.logs}
        for folder in ("tables", "log"):
            for name in self.files.names(f"{self.path}/{folder}"):
                at = f"{self.path}/{folder}/{name}"
                if at not in named and self.files.age(at) > unnamed_after:
                    self.files.remove(at)
        return len(old)

    def trim(self, upto: int) -> int:
        """Forget the files of change records that hold none beyond number ``upto``, which every follower must have; returns how many went."""
        with self.lock:
            s = self.state()
            gone = [x for x in s.logs if x[2] <= upto]
            after = State(**(s.__dict__ | {"version": s.version + 1, "logs": [x for x in s.logs if x[2] > upto]}))
            if gone and not self.files.create(f"{self.path}/versions/{after.version:012d}.json", json.dumps(after.__dict__)):
                raise ConflictError(f"version {after.version} was committed by another writer")
            for x in gone:
                self.files.remove(x[0])
            return len(gone)

    def changes(self, after: int = 0, upto: int | None = None) -> DataFrame:
        """Change records ``lsn, version, ts, op, payload`` of committed versions beyond ``after`` (and up to ``upto``); only files that hold such are read."""
        s = self.state()
        upto = s.lsn if upto is None else min(upto, s.lsn)
        files = [x[0] for x in s.logs if x[2] > after and x[1] <= upto]
        if not files:
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(*files).where((F.col("lsn") > after) & (F.col("lsn") <= upto)).orderBy("lsn")

    # queries

    def cypher(self, text: str, params: Mapping[str, Any] | None = None) -> DataFrame | Written:
        """A read gives its rows; CREATE, MERGE, SET and DELETE commit and give ``Written``."""
        q = prepared(text, params)
        if q.kind == "match" and not q.sets and not q.deletes:
            return read(self.graph(), text, params)
        tx = self.begin()
        out = tx.run(q)
        tx.commit()
        return out


LOG = "lsn bigint, version bigint, ts double, op string, payload string"


def _paths(s: State) -> set[str]:
    return {p for tables in (s.nodes, s.edges) for parts in tables.values() for _, p in parts}


@dataclass(frozen=True)
class Snapshot:
    """Queries on one version, whatever is committed later."""

    store: Store
    version: int

    def graph(self) -> Graph:
        return self.store.graph(self.version)

    def cypher(self, text: str, params: Mapping[str, Any] | None = None) -> DataFrame:
        return read(self.graph(), text, params)

    def release(self) -> None:
        """Nothing is held: a version's files stay until ``prune``."""


class Tx:
    """Changes on top of one version, seen by this transaction's own reads, and committed together or not at all."""

    def __init__(self, store: Store, state: State):
        self.store, self.spark, self.state = store, store.spark, state
        self.parts = {kind: {k: [list(p) for p in v] for k, v in getattr(state, kind).items()} for kind in ("nodes", "edges")}
        self.added: list[tuple[str, str]] = []  # of node tables: name, path
        self.next_node, self.next_edge = state.next_node, state.next_edge
        self.indexes, self.unique = [list(x) for x in state.indexes], [list(x) for x in state.unique]
        self.changes: list[tuple[str, dict]] = []
        self.done = False

    def graph(self) -> Graph:
        return _graph(self.spark, self.parts["nodes"], self.parts["edges"], self.indexes)

    def commit(self) -> int:
        self._open()
        self.done = True
        return self.store.commit(self)

    def rollback(self) -> None:
        self.done = True

    def _open(self) -> None:
        if self.done:
            raise RuntimeError("the transaction has ended")

    def _log(self, op: str, **payload: Any) -> None:
        self._open()
        self.changes.append((op, payload))

    # tables of this transaction

    def table(self, kind: str, name: str) -> DataFrame | None:
        parts = self.parts[kind].get(name)
        return table_of(self.spark, parts) if parts else None

    def names(self, kind: str) -> list[str]:
        return sorted(k for k, v in self.parts[kind].items() if v)

    def _written(self, df: DataFrame) -> str:
        """The frame as a table of the store: sorted by the first index whose keys it has, with Bloom filters on every index's keys."""
        at, columns = f"{self.store.path}/tables/{uuid.uuid4().hex}", set(df.columns)
        fitting = [keys for keys in self.indexes if set(keys) <= columns]
        if fitting:
            df = df.sortWithinPartitions(*fitting[0])
        writer = df.write
        for key in {k for keys in fitting for k in keys}:
            writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
        writer.parquet(at)
        return at

    def _part(self, kind: str, name: str, how: str, at: str) -> None:
        self._open()
        self.parts[kind].setdefault(name, []).append([how, at])
        if kind == "nodes" and how == ADDED:
            self.added.append((name, at))

    def put(self, kind: str, name: str, df: DataFrame) -> None:
        """The table written anew as one part; an index's seeks profit from rows that lie together."""
        keys = next((k for k in self.indexes if set(k) <= set(df.columns)), None)
        at = self._written(df.repartitionByRange(*keys) if keys else df)
        self.parts[kind][name] = [[ADDED, at]]

    def merge_parts(self) -> None:
        for kind, tables in self.parts.items():
            for name, parts in tables.items():
                if len(parts) > MOST_PARTS:
                    self.put(kind, name, table_of(self.spark, parts))

    def _homes(self, kind: str, ids: DataFrame) -> list[str]:
        """The names of the tables that have any of the ids, in one job."""
        frames = [self.table(kind, name).join(ids.select("id"), "id", "left_semi").select(F.lit(name).alias("name")).limit(1) for name in self.names(kind)]
        return sorted(r[0] for r in reduce(DataFrame.unionAll, frames).collect()) if frames else []

    def _home(self, kind: str, one: int) -> str:
        frames = [self.table(kind, name).where(F.col("id") == one).select(F.lit(name).alias("name")).limit(1) for name in self.names(kind)]
        found = reduce(DataFrame.unionAll, frames).first() if frames else None
        if found is None:
            raise KeyError(f"no such {kind[:-1]}: {one}")
        return found[0]

    def _ids(self, ids: list[int]) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], "id bigint")

    # nodes

    def get_node(self, node: int) -> dict[str, Any] | None:
        rows = self.graph().node(node).collect()
        return {k: v for k, v in rows[0].asDict().items() if k != KEYS} if rows else None

    def add_node(self, props: Mapping[str, Any], labels: Iterable[str] = ()) -> int:
        return self.add_nodes([props], labels)[0]

    def add_nodes(self, rows: list[Mapping[str, Any]], labels: Iterable[str] = ()) -> list[int]:
        ids = list(range(self.next_node, self.next_node + len(rows)))
        self.next_node += len(rows)
        self._log("add_nodes", ids=ids, labels=sorted(set(labels)), props=[dict(r) for r in rows])
        if ids:
            self._part("nodes", _key(labels), ADDED, self._written(_frame(self.spark, [({"id": i}, dict(r)) for i, r in zip(ids, rows, strict=True)])))
        return ids

    def load_nodes(self, df: DataFrame, labels: Iterable[str]) -> None:
        at = self._written(df)
        top = self.spark.read.parquet(at).agg(F.max("id")).first()[0] or 0
        self.next_node = max(self.next_node, top + 1)
        self._part("nodes", _key(labels), ADDED, at)
        self._log("load_nodes", labels=sorted(set(labels)), path=at)

    def _change(self, kind: str, name: str, which: DataFrame, at: str, props: Mapping[str, Any], replace: bool = False) -> None:
        """Give rows of one table, those of ``which`` (ids, at path ``at``), new values; other properties stay, or go if ``replace``."""
        df = self.table(kind, name)
        types = {f.name: f.dataType for f in df.schema}
        df = df.join(which.select("id"), "id", "left_semi")
        fixed = {"id", "src", "dst", KEYS}
        sample = _frame(self.spark, [({"id": 0}, dict(props))]).schema
        out = []
        for c in [*(c for c in df.columns if c != KEYS), *(c for c in props if c not in df.columns)]:
            if c not in fixed and c in props:
                kept = types.get(c, T.NullType())
                new, own = F.lit(props[c]), sample[c].dataType
                numbers = isinstance(kept, T.NumericType) and isinstance(own, T.NumericType)
                if props[c] is None:
                    new = new.cast(kept if c in types else "string")
                elif not isinstance(kept, T.NullType) and kept != own and not numbers:
                    new = new.cast("string")
                out.append(new.alias(c))
            else:
                out.append((F.lit(None).cast(types[c]) if replace and c not in fixed else F.col(f"`{c}`")).alias(c))
        if KEYS in df.columns:
            given = F.array(*map(F.lit, sorted(props))).cast("array<string>")
            out.append((given if replace else F.array_sort(F.array_union(F.coalesce(KEYS, F.array().cast("array<string>")), given))).alias(KEYS))
        rows = self._written(df.select(*out))
        self._part(kind, name, GONE, at)
        self._part(kind, name, ADDED, rows)

    def _change_one(self, kind: str, one: int, props: Mapping[str, Any], replace: bool = False) -> None:
        name = self._home(kind, one)
        self._change(kind, name, self._ids([one]), self._written(self._ids([one]).coalesce(1)), props, replace)

    def update_node(self, node: int, props: Mapping[str, Any]) -> None:
        self._change_one("nodes", node, props)
        self._log("update_node", id=node, props=dict(props))

    def set_node_props(self, node: int, props: Mapping[str, Any]) -> None:
        self._change_one("nodes", node, props, replace=True)
        self._log("set_node_props", id=node, props=dict(props))

    def delete_nodes(self, nodes: list[int] | DataFrame) -> None:
        """The nodes and every edge that ends at one of them."""
        if isinstance(nodes, list):
            for n in nodes:
                self._home("nodes", n)
            self._log("delete_nodes", ids=nodes)
            at = self._written(self._ids(nodes).coalesce(1))
        else:
            at = self._written(nodes.select("id").distinct())
            self._log("delete_nodes", path=at)
        gone = self.spark.read.parquet(at)
        for name in self._homes("nodes", gone):
            self._part("nodes", name, GONE, at)
        ends = [gone.select(F.col("id").alias(end)) for end in ("src", "dst")]
        for name in self.names("edges"):
            df = self.table("edges", name).select("id", "src", "dst")
            hit = self._written(df.join(ends[0], "src", "left_semi").select("id").unionAll(df.join(ends[1], "dst", "left_semi").select("id")).distinct())
            if not self.spark.read.parquet(hit).isEmpty():
                self._part("edges", name, GONE, hit)

    def relabel(self, node: int, add: Iterable[str] = (), remove: Iterable[str] = ()) -> None:
        name = self._home("nodes", node)
        labels = ({*_labels(name)} | set(add)) - set(remove)
        if _key(labels) != name:
            row = self._written(self.table("nodes", name).where(F.col("id") == node).coalesce(1))
            self._part("nodes", name, GONE, self._written(self._ids([node]).coalesce(1)))
            self._part("nodes", _key(labels), ADDED, row)
        self._log("relabel", id=node, add=sorted(add), remove=sorted(remove))

    # edges

    def add_edge(self, src: int, dst: int, label: str, props: Mapping[str, Any] = {}) -> int:
        return self.add_edges([(src, dst, label, props)], check=True)[0]

    def add_edges(self, rows: list[tuple], check: bool = False) -> list[int]:
        """``(src, dst, label, properties)`` each; with ``check`` both ends must exist."""
        if check:
            ends = sorted({x for r in rows for x in r[:2]})
            known = {r[0] for r in self.graph().nodes(columns=()).where(F.col("id").isin(ends)).select("id").collect()}
            if missing := [x for x in ends if x not in known]:
                raise KeyError(f"no such node: {missing[0]}")
        ids = list(range(self.next_edge, self.next_edge + len(rows)))
        self.next_edge += len(rows)
        by_label: dict[str, list] = {}
        for i, (src, dst, label, props) in zip(ids, rows, strict=True):
            by_label.setdefault(label, []).append(({"id": i, "src": src, "dst": dst}, dict(props)))
        for label, part in by_label.items():
            self._part("edges", label, ADDED, self._written(_frame(self.spark, part)))
        self._log("add_edges", ids=ids, rows=[[s, d, label, dict(p)] for s, d, label, p in rows])
        return ids

    def load_edges(self, df: DataFrame, label: str, check: bool = False) -> None:
        if check:
            known = self.graph().nodes(columns=()).select(F.col("id").alias("known"))
            for end in ("src", "dst"):
                if not df.join(known, df[end] == known["known"], "left_anti").limit(1).isEmpty():
                    raise KeyError(f"{label}: an edge's {end} doesn't exist")
        at = self._written(df)
        self.next_edge = max(self.next_edge, (self.spark.read.parquet(at).agg(F.max("id")).first()[0] or 0) + 1)
        self._part("edges", label, ADDED, at)
        self._log("load_edges", label=label, path=at)

    def update_edge(self, edge: int, props: Mapping[str, Any]) -> None:
        self._change_one("edges", edge, props)
        self._log("update_edge", id=edge, props=dict(props))

    def delete_edges(self, edges: list[int] | DataFrame) -> None:
        if isinstance(edges, list):
            for e in edges:
                self._home("edges", e)
            at = self._written(self._ids(edges).coalesce(1))
            self._log("delete_edges", ids=edges)
        else:
            at = self._written(edges.select("id").distinct())
            self._log("delete_edges", path=at)
        for name in self._homes("edges", self.spark.read.parquet(at)):
            self._part("edges", name, GONE, at)

    def set_many(self, kind: str, which: DataFrame, props: Mapping[str, Any]) -> None:
        """Merge the properties into every node or edge of ``which``."""
        at = self._written(which.select("id").distinct())
        which = self.spark.read.parquet(at)
        for name in self._homes(kind, which):
            self._change(kind, name, which, at, props)
        self._log("set_many", kind=kind, path=at, props=dict(props))

    # declarations

    def declare(self, index: list[str] | None = None, drop_index: list[str] | None = None, unique: list[str] | None = None, drop_unique: list[str] | None = None) -> None:
        for value, to, add in ((index, self.indexes, True), (drop_index, self.indexes, False), (unique, self.unique, True), (drop_unique, self.unique, False)):
            if value is not None:
                if add and value not in to:
                    to.append(value)
                elif not add and value in to:
                    to.remove(value)
        if index is not None:
            for name in self.names("nodes"):
                df = self.table("nodes", name)
                if set(index) <= set(df.columns):
                    self.put("nodes", name, df)
        self._log("declare", index=index, drop_index=drop_index, unique=unique, drop_unique=drop_unique)

    # writing queries

    def run(self, q: Query) -> Written:
        self._open()
        if q.kind == "create":
            return self._create(q)
        if q.kind == "merge":
            return self._merge(q)
        if not q.sets and not q.deletes:
            return Written(planned(self.graph(), q)[0], Stats())
        return self._mutate(q)

    def _create(self, q: Query) -> Written:
        """Patterns from left to right; a variable that is bound again means the same node."""
        stats, nodes, edges = Stats(), {}, {}

        def node(p: NodePattern) -> int:
            if p.var in nodes:
                return nodes[p.var]
            props = {k: _value(v) for k, v in p.props}
            made = self.add_node(props, p.labels)
            stats.nodes_created, stats.labels_set, stats.props_set = stats.nodes_created + 1, stats.labels_set + len(p.labels), stats.props_set + len(props)
            if p.var:
                nodes[p.var] = made
            return made

        for p in q.patterns:
            ids = [node(n) for n in p.nodes]
            for rel, a, b in zip(p.rels, ids, ids[1:], strict=False):
                if not rel.label or rel.hops:
                    raise CypherError("CREATE needs a relationship with one label")
                made = self.add_edges([(b, a, rel.label, {}) if rel.direction == "in" else (a, b, rel.label, {})])[0]
                stats.edges_created += 1
                if rel.var:
                    edges[rel.var] = made
        return Written(self._returned(q, nodes, edges) if q.items else None, stats)

    def _merge(self, q: Query) -> Written:
        p = q.patterns[0].nodes[0]
        stats, props = Stats(), {k: _value(v) for k, v in p.props}
        df = self.graph().nodes(p.labels)
        for k, v in p.props:
            df = df.where(Binder._inline(df, k, v))
        found = df.agg(F.min("id")).first()[0]
        sets = {a.key: _value(a.expr) for a in (q.on_create if found is None else q.on_match)}
        if found is None:
            found = self.add_node(props | sets, p.labels)
            stats = Stats(nodes_created=1, labels_set=len(p.labels), props_set=len(props | sets))
        elif sets:
            self.update_node(found, sets)
            stats.props_set = len(sets)
        return Written(self._returned(q, {p.var: found} if p.var else {}, {}) if q.items else None, stats)

    def _returned(self, q: Query, nodes: dict[str, int], edges: dict[str, int]) -> DataFrame:
        """The one row that CREATE or MERGE returns."""
        b, g, df = Binder(self.graph(), q), self.graph(), None
        for var, one in nodes.items():
            own = b._prefixed(g.node(one), var, "node")
            df = own if df is None else df.crossJoin(own)
        for var, one in edges.items():
            own = b._prefixed(g.edge(one), var, "edge")
            df = own if df is None else df.crossJoin(own)
        if df is None:
            raise CypherError("nothing is bound to return")
        return df.select(*(b.typed(i.expr)[0].alias(i.name) for i in q.items))

    def _mutate(self, q: Query) -> Written:
        """MATCH … SET / DELETE: every match is changed, whatever is returned; the rows are those after SET, or before DELETE."""
        df, b, step = matched(self.graph(), q)
        stats = Stats()
        for s in q.sets:
            b._known(s.var)
        hits = {v: cut(df.select(b.column(v, "id").alias("id")).where("id IS NOT NULL").distinct()) for v in {*(s.var for s in q.sets), *q.deletes} if v in b.kinds}
        for v in q.deletes:
            b._known(v)
        rows = None
        if q.deletes:
            rows = cut(project(df, b, q, step)[0])
        else:
            keys = cut(df.select(*(b.column(v, "id").alias(v) for v in b.kinds)))
        for var in dict.fromkeys(s.var for s in q.sets):
            props = {s.key: _value(s.expr) for s in q.sets if s.var == var}
            self.set_many(b.kinds[var] + "s", hits[var], props)
            stats.props_set += len(props) * hits[var].count()
        for var in q.deletes:
            n = hits[var].count()
            if b.kinds[var] == "node":
                self.delete_nodes(hits[var])
                stats.nodes_deleted += n
            else:
                self.delete_edges(hits[var])
                stats.edges_deleted += n
        if rows is None:
            rows = self._after(q, b, keys)
        return Written(rows, stats)

    def _after(self, q: Query, old: Binder, keys: DataFrame) -> DataFrame:
        """The matched bindings, read again by id after they were changed."""
        g = self.graph()
        b, out = Binder(g, q), keys.select(*(F.col(f"`{v}`").alias(f" {v}") for v in old.kinds))
        for var, kind in old.kinds.items():
            own = b._prefixed(g.nodes() if kind == "node" else g.edges(), var, kind)
            out = out.join(own, F.col(f"` {var}`") == b.column(var, "id"), "left").drop(f" {var}")
        from arcloom.plans.compile import Step

        return project(out, b, q, Step(""))[0]


def _value(x: Any) -> Any:
    if not isinstance(x, Lit):
        raise CypherError("only a literal or a parameter can be stored")
    return x.value
