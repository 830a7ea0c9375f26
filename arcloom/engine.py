"""Running queries under limits, with a log of slow ones, counters, prepared statements and result streams."""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from collections import deque
from collections.abc import Iterator, Mapping
from typing import Any

from pyspark.sql import DataFrame, Row

from arcloom.model import Graph
from arcloom.operators.adjacency import display_label, subgraph
from arcloom.plans.parser import parse
from arcloom.store import Store, Written


class ResultTooLarge(RuntimeError):
    pass


class QueryTimeout(RuntimeError):
    pass


class QueryFailed(RuntimeError):
    pass


class Engine:
    """Queries on a graph or a store."""

    def __init__(self, on: Graph | Store, max_rows: int | None = None, timeout: float | None = None, slow: float = 0.1, kept: int = 100):
        self.on, self.spark = on, on.spark
        self.max_rows, self.timeout, self.slow_after = max_rows, timeout, slow
        self.slow_queries: deque[dict] = deque(maxlen=kept)
        self.counters = {"queries_total": 0, "query_errors_total": 0, "slow_queries_total": 0, "rows_total": 0, "query_seconds_sum": 0.0, "query_seconds_max": 0.0}
        self.statements: dict[str, str] = {}
        self.lock = threading.Lock()

    def frame(self, text: str, params: Mapping[str, Any] | None = None) -> DataFrame | Written:
        return self.on.cypher(text, params)

    def run(self, text: str, params: Mapping[str, Any] | None = None) -> list[Row]:
        """All rows. More than ``max_rows`` raise ``ResultTooLarge``, whatever plan led to them; a query over ``timeout``
        seconds is cancelled; any other error comes as ``QueryFailed``."""
        sc, group, began, rows = self.spark.sparkContext, f"arcloom-{uuid.uuid4().hex}", time.perf_counter(), []
        late = threading.Event()

        def stop() -> None:
            late.set()
            sc.cancelJobGroup(group)

        timer = threading.Timer(self.timeout, stop) if self.timeout else None
        try:
            sc.setJobGroup(group, text[:200], interruptOnCancel=True)
            if timer:
                timer.start()
            out = self.frame(text, params)
            df = out.rows if isinstance(out, Written) else out
            rows = [] if df is None else df.collect() if self.max_rows is None else df.limit(self.max_rows + 1).collect()
            if late.is_set():
                raise QueryTimeout(f"over {self.timeout} s")
            if self.max_rows is not None and len(rows) > self.max_rows:
                raise ResultTooLarge(f"over {self.max_rows} rows")
            return rows
        except Exception as e:
            with self.lock:
                self.counters["query_errors_total"] += 1
            if late.is_set():
                raise QueryTimeout(f"over {self.timeout} s") from e
            if isinstance(e, (ResultTooLarge, ValueError, KeyError)):
                raise
            raise QueryFailed(str(e)[:500]) from e
        finally:
            if timer:
                timer.cancel()
            sc.setLocalProperty("spark.jobGroup.id", None)
            self._seen(text, time.perf_counter() - began, len(rows))

    def _seen(self, text: str, seconds: float, rows: int) -> None:
        with self.lock:
            c = self.counters
            c["queries_total"] += 1
            c["rows_total"] += rows
            c["query_seconds_sum"] += seconds
            c["query_seconds_max"] = max(c["query_seconds_max"], seconds)
            if seconds >= self.slow_after:
                c["slow_queries_total"] += 1
                self.slow_queries.append({"query": text if len(text) <= 500 else text[:500] + "...", "seconds": seconds, "rows": rows, "at": time.time()})

    # prepared statements

    def prepare(self, text: str) -> str:
        """Parse once; the statement's name is the start of the text's SHA-256."""
        parse(text)
        name = hashlib.sha256(text.encode()).hexdigest()[:16]
        self.statements[name] = text
        return name

    def execute(self, name: str, params: Mapping[str, Any] | None = None) -> list[Row]:
        return self.run(self.statements[name], params)

    @staticmethod
    def cache_stats() -> dict[str, int]:
        info = parse.cache_info()
        return {"hits": info.hits, "misses": info.misses, "entries": info.currsize, "capacity": info.maxsize}

    # sinks

    def rows(self, text: str, params: Mapping[str, Any] | None = None) -> Iterator[Row]:
        """Rows one by one, a partition at a time."""
        out = self.frame(text, params)
        df = out.rows if isinstance(out, Written) else out
        if df is not None:
            yield from df.toLocalIterator(prefetchPartitions=True)

    def ndjson(self, text: str, params: Mapping[str, Any] | None = None) -> Iterator[str]:
        """A JSON line for each row; an error is the last line."""
        try:
            for row in self.rows(text, params):
                yield json.dumps(row.asDict(True), default=str)
        except Exception as e:
            yield json.dumps({"error": str(e)[:500]})

    def json(self, text: str, params: Mapping[str, Any] | None = None) -> dict:
        """Columns, rows, the part of the graph that the rows' nodes span, their number and the time."""
        began = time.perf_counter()
        rows = [r.asDict(True) for r in self.run(text, params)]
        found = sorted({v["id"] for r in rows for v in r.values() if isinstance(v, dict) and "labels" in v and v.get("id") is not None})
        drawn: dict[str, list] = {"nodes": [], "edges": []}
        if found:
            g = self.on if isinstance(self.on, Graph) else self.on.graph()
            nodes, edges = subgraph(g, self.spark.createDataFrame([(i,) for i in found], "id bigint"))
            drawn["nodes"] = [r.asDict() for r in nodes.select("id", "labels", display_label(nodes.columns).alias("label")).collect()]
            drawn["edges"] = [r.asDict() for r in edges.select("id", "src", "dst", "label").collect()]
        return {"columns": list(rows[0]) if rows else [], "rows": rows, "graph": drawn, "rowCount": len(rows), "execTimeMs": (time.perf_counter() - began) * 1000}

    def prometheus(self) -> str:
        """The counters in the text format that Prometheus reads."""
        kinds = {k: "counter" if k.endswith(("_total", "_sum")) else "gauge" for k in self.counters}
        return "".join(f"# TYPE arcloom_{k} {kinds[k]}\narcloom_{k} {v}\n" for k, v in self.counters.items())
