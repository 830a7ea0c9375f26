"""More queries of the entry module: writes, transactions, change records, engine, traversals with their paths; each with its SQL."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcloom.builder import Traversal, number_of, text_of, together
from arcloom.engine import Engine
from arcloom.model import BOTH, IN, OUT, Graph
from arcloom.operators import adjacency, pages, paths, traversal
from arcloom.queries import CUSTOMER, FOUND, NATION, ORDER, PART, REGION, SUPPLIER, _id, query
from arcloom.scratch import shared_dir
from arcloom.sources.files import FORMATS, files_graph
from arcloom.sources.tables import KIND, LINES, PARTS, tables_graph
from arcloom.store import Store
from arcloom.streaming.replay import follow, replay

#: The tables that a store of these queries is loaded with, whole.
NODES, EDGES = ("Region", "Nation", "Customer", "Supplier"), ("IN_REGION", "LIVES_IN", "BASED_IN")
_COUNT = "(SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)"


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def loaded(spark: SparkSession, sf_dir: str) -> Store:
    """A new store in the shared folder with the four tables and what links them, in one transaction."""
    g, store = tables_graph(spark, sf_dir), Store(spark, _place(spark, "store"))
    tx = store.begin()
    for label in NODES:
        tx.load_nodes(g.node_tables[label,], [label])
    for label in EDGES:
        tx.load_edges(g.edge_tables[label], label, check=True)
    tx.commit()
    return store


def on_store(sql: str | None):
    """Register a function of a loaded store under its name, with its SQL."""

    def add(f):
        FOUND[f.__name__] = (lambda spark, sf_dir: f(loaded(spark, sf_dir)), sql)
        return f

    return add


def _error(f: Callable[[], Any]) -> str:
    """The name of the error that a call raises."""
    try:
        f()
    except Exception as e:
        return type(e).__name__
    return "none"


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# reading by the API


@query("SELECT c_custkey AS custkey FROM customer WHERE c_acctbal > 9000 AND c_mktsegment = 'MACHINERY'")
def find_nodes(g: Graph) -> DataFrame:
    return g.find((F.col("acctbal") > 9000) & (F.col("mktsegment") == "MACHINERY")).select("custkey")


@query("SELECT n_name AS name FROM nation WHERE n_regionkey = 2 UNION ALL SELECT r_name FROM region WHERE r_regionkey = 2")
def find_by_property(g: Graph) -> DataFrame:
    return g.find_by_property("regionkey", 2).select("name")


@query("SELECT o_orderkey AS orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '5-LOW'")
def find_by_properties(g: Graph) -> DataFrame:
    return g.find_by_properties({"orderstatus": "O", "orderpriority": "5-LOW"}).select("orderkey")


@query(f"SELECT {NATION} AS id, n_regionkey AS regionkey FROM nation WHERE n_name = (SELECT max(n_name) FROM nation)")
def find_unique(g: Graph) -> DataFrame:
    last = g.nodes(("Nation",), ("name",)).agg(F.max("name")).first()[0]
    return g.find_unique("Nation", "name", last).select("id", "regionkey")


@query(f"SELECT {PART} AS id, p_name AS name FROM part")
def find_by_label(g: Graph) -> DataFrame:
    return g.find_by_label("Part").select("id", "name")


@query(f"SELECT {_id(14, 'o_orderkey')} AS id, {_id(3, 'o_custkey')} AS src, {ORDER} AS dst FROM orders")
def edges_of_type(g: Graph) -> DataFrame:
    return g.edges("PLACED").select("id", "src", "dst")


@query(f"SELECT {_id(16, f'CAST(l_suppkey AS BIGINT) * {PARTS} + l_partkey')} AS id, {_id(4, 'l_suppkey')} AS src, {_id(6, 'l_partkey')} AS dst FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)")
def edges_of_pairs(g: Graph) -> DataFrame:
    return g.edges("SUPPLIES").select("id", "src", "dst")


@query(f"SELECT {_id(15, f'l_orderkey * CAST({LINES} AS BIGINT) + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)')} AS id, {_id(5, 'l_orderkey')} AS src, {_id(6, 'l_partkey')} AS dst FROM lineitem")
def edges_of_lines(g: Graph) -> DataFrame:
    return g.edges("CONTAINS").select("id", "src", "dst")


@query(f"SELECT {NATION} AS id, 'Nation' AS label, n_name AS name FROM nation WHERE n_nationkey = 7")
def point_node(g: Graph) -> DataFrame:
    return g.node(KIND * 2 + 8).select("id", F.col("labels")[0].alias("label"), "name")


@query(f"SELECT {_id(11, 'n_nationkey')} AS id, {NATION} AS src, {_id(1, 'n_regionkey')} AS dst, 'IN_REGION' AS label FROM nation WHERE n_nationkey = 7")
def point_edge(g: Graph) -> DataFrame:
    return g.edge(KIND * 11 + 8).select("id", "src", "dst", "label")


@query("SELECT (SELECT count(*) FROM nation WHERE n_nationkey = 7) > 0 AS there, (SELECT count(*) FROM nation WHERE n_nationkey = 7000) > 0 AS absent")
def node_exists(g: Graph) -> DataFrame:
    return _rows(g.spark, [(g.node_exists(KIND * 2 + 8), g.node_exists(KIND * 2 + 7001))], "there boolean, absent boolean")


@query(f"SELECT {_COUNT} + (SELECT count(*) FROM orders) + (SELECT count(*) FROM part) + (SELECT count(DISTINCT user_id) FROM events) + (SELECT count(*) FROM events) AS nodes")
def node_count(g: Graph) -> DataFrame:
    return _rows(g.spark, [(g.node_count(),)], "nodes bigint")


_SHARD = f"""
    WITH n AS (SELECT {REGION} AS id FROM region UNION ALL SELECT {NATION} FROM nation UNION ALL SELECT {SUPPLIER} FROM supplier),
    e AS (SELECT {NATION} AS src FROM nation UNION ALL SELECT {SUPPLIER} FROM supplier)
    SELECT CAST(s AS BIGINT) AS shard, (SELECT count(*) FROM n WHERE id % 4 = s) AS nodes, (SELECT count(*) FROM e WHERE src % 4 = s) AS edges FROM range(4) t(s)"""


@query(_SHARD)
def shard_stats(g: Graph) -> DataFrame:
    part = Graph(g.spark, {(k,): g.node_tables[k,] for k in ("Region", "Nation", "Supplier")}, {k: g.edge_tables[k] for k in ("IN_REGION", "BASED_IN")})
    return part.shard_stats(4)


@query(f"SELECT {REGION} AS id, r_name AS shown FROM region UNION ALL SELECT {ORDER}, CAST({ORDER} AS VARCHAR) FROM orders")
def display_labels(g: Graph) -> DataFrame:
    named = g.nodes(("Region",))
    other = g.nodes(("SalesOrder",))
    return named.select("id", adjacency.display_label(named.columns).alias("shown")).unionAll(other.select("id", adjacency.display_label(other.columns).alias("shown")))


@query("SELECT c_custkey AS custkey, CAST(c_acctbal AS VARCHAR) IS NOT NULL AS has_text, coalesce(CAST(c_acctbal AS DOUBLE), 0) AS balance, coalesce(CAST(c_nationkey AS DOUBLE), -1) AS nation, 0.5 AS of_text FROM customer")
def typed_getters(g: Graph) -> DataFrame:
    return g.nodes(("Customer",)).select("custkey", (text_of("acctbal") != "").alias("has_text"), number_of("acctbal").alias("balance"), number_of("nationkey", -1.0).alias("nation"), number_of("mktsegment", 0.5).cast("decimal(2,1)").alias("of_text"))


# the language


@query("SELECT n_name AS \"n.name\" FROM nation WHERE n_name <> 'limit'")
def quoted_names(g: Graph) -> DataFrame:
    return g.cypher("MATCH (`n`:`Nation`) WHERE `n`.`name` <> 'limit' RETURN `n`.`name`").toDF("n.name")


@query("SELECT * FROM (VALUES ('function', 'CypherError'), ('remove', 'CypherError'), ('syntax', 'CypherError'), ('unbound', 'CypherError'), ('value missing', 'CypherError'), ('write on a graph', 'CypherError')) t(what, error)")
def language_errors(g: Graph) -> DataFrame:
    asked = {
        "unbound": "MATCH (n:Nation) WHERE m.name = 'x' RETURN n.name", "function": "MATCH (n:Nation) RETURN size(n)", "remove": "MATCH (n:Nation) REMOVE n.name", "syntax": "MATCH n:Nation RETURN n",
        "value missing": "MATCH (n:Nation {name: $x}) RETURN n.name", "write on a graph": "CREATE (n:Nation {name: 'x'})",
    }
    return _rows(g.spark, [(k, _error(lambda q=q: g.cypher(q).collect())) for k, q in asked.items()], "what string, error string")


_PLAN = """SELECT * FROM (VALUES (0, 'EXPLAIN:'), (1, 'ProduceResults (n.name)'), (2, '└── Projection (n.name)'), (3, '    └── Limit (3)'), (4, '        └── Sort (n.name)'), (5, '            └── {}'), (6, '                └── NodeByLabelScan (n:Nation)')) t(i, line)"""


@query(_PLAN.format("Filter (n.regionkey = 1)"))
def explain_plan(g: Graph) -> DataFrame:
    lines = [r[0] for r in g.cypher("EXPLAIN MATCH (n:Nation {regionkey: 1}) RETURN n.name ORDER BY n.name LIMIT 3").collect()]
    return _rows(g.spark, list(enumerate(lines)), "i int, line string")


@on_store(_PLAN.format("NodeIndexSeek (n.regionkey = 1)"))
def explain_index_seek(store: Store) -> DataFrame:
    store.create_index("regionkey")
    lines = store.graph().explain("MATCH (n:Nation {regionkey: 1}) RETURN n.name ORDER BY n.name LIMIT 3").split("\n")
    return _rows(store.spark, list(enumerate(lines)), "i int, line string")


@query("SELECT 'NodeByLabelScan' AS step, count(*) AS n FROM customer UNION ALL SELECT 'Filter', count(*) FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT 'Projection', count(*) FROM customer WHERE c_acctbal > 5000")
def profile_rows(g: Graph) -> DataFrame:
    lines = g.cypher("PROFILE MATCH (c:Customer) WHERE c.acctbal > 5000 RETURN c.custkey").select(F.trim(F.regexp_replace("plan", "[└├│─]", "")).alias("line"))
    return lines.where("line NOT LIKE 'PROFILE%' AND line NOT LIKE 'ProduceResults%'").select(F.split("line", " ")[0].alias("step"), F.regexp_extract("line", r"rows=(\d+)", 1).cast("bigint").alias("n"))


# the engine


@query("SELECT n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def engine_prepared(g: Graph) -> DataFrame:
    e = Engine(g)
    name = e.prepare("MATCH (n:Nation)-[:IN_REGION]->(r:Region {name: $region}) RETURN n.name, r.name")
    found = [tuple(x) for r in e.run("MATCH (r:Region) RETURN r.name") for x in e.execute(name, {"region": r[0]})]
    return _rows(g.spark, found, "name string, region string")


@query("SELECT c_custkey AS custkey, c_name AS name FROM customer")
def engine_iterator(g: Graph) -> DataFrame:
    return _rows(g.spark, [tuple(r) for r in Engine(g).rows("MATCH (c:Customer) RETURN c.custkey, c.name")], "custkey bigint, name string")


@query("SELECT s_suppkey AS suppkey, s_name AS name FROM supplier")
def engine_ndjson(g: Graph) -> DataFrame:
    lines = [json.loads(x) for x in Engine(g).ndjson("MATCH (s:Supplier) RETURN s.suppkey AS k, s.name AS name")]
    return _rows(g.spark, [(x["k"], x["name"]) for x in lines], "suppkey bigint, name string")


@query("SELECT 'rows' AS part, count(*) AS n FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'nodes', count(*) + 1 FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'edges', count(*) FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'columns', 2")
def engine_json(g: Graph) -> DataFrame:
    out = Engine(g).json("MATCH (n:Nation {regionkey: 1})-[:IN_REGION]->(r:Region) RETURN n, r")
    parts = {"rows": out["rowCount"], "nodes": len(out["graph"]["nodes"]), "edges": len(out["graph"]["edges"]), "columns": len(out["columns"])}
    return _rows(g.spark, list(parts.items()), "part string, n bigint")


@query("SELECT * FROM (VALUES ('cap', 'ResultTooLarge'), ('error', 'CypherError'), ('time', 'QueryTimeout')) t(what, error)")
def engine_limits(g: Graph) -> DataFrame:
    slow = type("Slow", (), {"spark": g.spark, "cypher": lambda self, text, params=None: g.spark.sql("SELECT count(*) FROM range(0, 20000000000, 1, 8) a WHERE hash(a.id) % 1000003 = hash(a.id + 1) % 1000033")})()
    asked = {"cap": lambda: Engine(g, max_rows=3).run("MATCH (n:Nation) RETURN n.name"), "error": lambda: Engine(g).run("NOT A QUERY"), "time": lambda: Engine(slow, timeout=1.0).run("slow")}
    return _rows(g.spark, [(k, _error(f)) for k, f in asked.items()], "what string, error string")


@query("SELECT 'queries_total' AS name, 3 AS value UNION ALL SELECT 'query_errors_total', 1 UNION ALL SELECT 'slow_queries_total', 3 UNION ALL SELECT 'rows_total', 2 * (SELECT count(*) FROM nation)")
def engine_counters(g: Graph) -> DataFrame:
    e = Engine(g, slow=0)
    for _ in range(2):
        e.run("MATCH (n:Nation) RETURN n.name")
    _error(lambda: e.run("NOT A QUERY"))
    text = [x.split() for x in e.prometheus().splitlines() if not x.startswith("#")]
    shown = {k.removeprefix("arcloom_"): v for k, v in text}
    assert len(e.slow_queries) == 3
    return _rows(g.spark, [(k, int(shown[k])) for k in ("queries_total", "query_errors_total", "slow_queries_total", "rows_total")], "name string, value bigint")


# sources

_FORMATS = " UNION ALL ".join(f"SELECT '{k}' AS kind, n_nationkey AS nationkey, n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey" for k in sorted(FORMATS))


@query(_FORMATS)
def file_formats(g: Graph) -> DataFrame:
    """The same nations, regions and edges from files of each format, by a query."""
    found, at = [], _place(g.spark, "files")
    for kind in sorted(FORMATS):
        tables = {"Nation": g.nodes(("Nation",), ("nationkey", "name")).drop("labels"), "Region": g.nodes(("Region",), ("name",)).drop("labels"), "IN_REGION": g.edges("IN_REGION", ()).drop("label")}
        for name, df in tables.items():
            df.write.format({"ndjson": "json", "tsv": "csv"}.get(kind, kind)).options(**FORMATS[kind]).save(f"{at}/{name}.{kind}")
        paths_of = {name: f"{at}/{name}.{kind}" for name in tables}
        read = files_graph(g.spark, {k: paths_of[k] for k in ("Nation", "Region")}, {"IN_REGION": paths_of["IN_REGION"]}, {name: df.schema for name, df in tables.items()} if kind != "json" else None)
        rows = read.cypher("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.nationkey, n.name, r.name").toDF("nationkey", "name", "region")
        found.append(rows.select(F.lit(kind).alias("kind"), F.col("nationkey").cast("bigint").alias("nationkey"), "name", "region"))
    out = found[0]
    for df in found[1:]:
        out = out.unionAll(df)
    return out


@query(f"SELECT {REGION} AS id, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def kept_tables(g: Graph) -> DataFrame:
    """Hot tables in executors' memory for as long as they are asked for."""
    with g.kept("Nation", "Region", edges=("IN_REGION",)) as hot:
        rows = hot.cypher("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN id(r)").toDF("id").groupBy("id").agg(F.count("*").alias("n")).collect()
    return _rows(g.spark, [tuple(r) for r in rows], "id bigint, n bigint")


# adjacency

_FOUR = KIND * 2 + 1 + 4


@query(f"SELECT {_id(13, 's_suppkey')} AS id, {SUPPLIER} AS src FROM supplier WHERE s_nationkey = 4")
def labelled_edges(g: Graph) -> DataFrame:
    return adjacency.edges_of(g, _FOUR, IN, "BASED_IN").select("id", "src")


@query(f"SELECT {_id(3, 'o_custkey')} AS node, {ORDER} AS id FROM orders")
def labelled_neighbors(g: Graph) -> DataFrame:
    part = Graph(g.spark, {(k,): g.node_tables[k,] for k in ("Customer", "SalesOrder")}, {"PLACED": g.edge_tables["PLACED"]})
    return adjacency.neighbors(part, part.nodes(("Customer",), ()).select("id"), OUT, "PLACED").select("node", "id")


@query(f"SELECT {NATION} AS node, {_id(1, 'n_regionkey')} AS id, 'out' AS side FROM nation UNION ALL SELECT {_id(2, 'c_nationkey')}, {CUSTOMER}, 'in' FROM customer UNION ALL SELECT {_id(2, 's_nationkey')}, {SUPPLIER}, 'in' FROM supplier")
def neighbors_by_direction(g: Graph) -> DataFrame:
    nations = g.nodes(("Nation",), ()).select("id")
    sides = [adjacency.neighbors(g, nations, d).select("node", "id", F.lit(d).alias("side")) for d in (OUT, IN)]
    return sides[0].unionAll(sides[1])


@query("SELECT (SELECT count(*) FROM nation WHERE n_nationkey = 4 AND n_regionkey = r) > 0 AS there, r AS region FROM (SELECT CAST(r_regionkey AS BIGINT) AS r FROM region)")
def has_any_edge(g: Graph) -> DataFrame:
    regions = [r[0] for r in g.nodes(("Region",), ("regionkey",)).select("regionkey").collect()]
    return _rows(g.spark, [(adjacency.has_edge(g, _FOUR, KIND + 1 + r), r) for r in regions], "there boolean, region bigint")


@query(f"SELECT {CUSTOMER} AS id, c_name AS name FROM customer WHERE {CUSTOMER} > {3 * KIND + 40} ORDER BY 1 LIMIT 20")
def page_label_by_key(g: Graph) -> DataFrame:
    first = pages.list_nodes(g, 0, 39, "Customer")
    assert first.more
    return pages.list_nodes(g, 3 * KIND + 40, 20, "Customer").items.select("id", "name")


@query(f"SELECT {NATION} AS id FROM nation")
def pages_in_turn(g: Graph) -> DataFrame:
    """All pages of a label, each from the cursor of the one before."""
    found, cursor, more = [], 0, True
    while more:
        page = pages.list_nodes(g, cursor, 7, "Nation")
        found += [(r.id,) for r in page.items.collect()]
        cursor, more = page.cursor, page.more
    return _rows(g.spark, found, "id bigint")


_FAULTS = f"""
    SELECT 'dangling edges' AS check_name, (SELECT count(*) FROM customer WHERE c_nationkey IN (3, 5)) + (SELECT count(*) FROM supplier WHERE s_nationkey IN (3, 5)) + (SELECT count(*) FROM nation WHERE n_nationkey IN (3, 5)) AS violations
    UNION ALL SELECT 'repeated edge ids', (SELECT count(*) FROM nation WHERE n_regionkey = 1) UNION ALL SELECT 'repeated node ids', (SELECT count(*) FROM supplier)"""


@query(_FAULTS)
def verify_faults(g: Graph) -> DataFrame:
    """Two nations are missing, suppliers are there twice, and so are the edges to one region."""
    nations, suppliers, links = g.node_tables["Nation",], g.node_tables["Supplier",], g.edge_tables["IN_REGION"]
    bad = Graph(
        g.spark, {("Region",): g.node_tables["Region",], ("Nation",): nations.where("nationkey NOT IN (3, 5)"), ("Customer",): g.node_tables["Customer",], ("Supplier",): suppliers, ("Other",): suppliers.select("id")},
        {"IN_REGION": links, "LIVES_IN": g.edge_tables["LIVES_IN"], "BASED_IN": g.edge_tables["BASED_IN"], "AGAIN": links.where(F.col("dst") == KIND + 2)},
    )
    found = adjacency.verify(bad)
    # an edge that is there twice dangles once
    return found.select("check_name", "violations")


# traversals and paths

#: From a region against the edges: its nations, then their customers and suppliers.
_START = KIND + 2
_TREE = f"""
    WITH a AS (SELECT {_id(11, 'n_nationkey')} AS e, {NATION} AS id, n_nationkey AS k FROM nation WHERE n_regionkey = 1),
    b AS (SELECT a.e, a.k, {_id(12, 'c_custkey')} AS e2, {CUSTOMER} AS id FROM a JOIN customer ON c_nationkey = a.k UNION ALL SELECT a.e, a.k, {_id(13, 's_suppkey')}, {SUPPLIER} FROM a JOIN supplier ON s_nationkey = a.k),
    t AS (SELECT {_START} AS id, 0 AS depth, '' AS path, 0 AS e, 0 AS e2 UNION ALL SELECT id, 1, CAST(e AS VARCHAR), e, 0 FROM a UNION ALL SELECT id, 2, concat(e, ',', e2), e, e2 FROM b)"""


def _path(df: DataFrame, *more: str) -> DataFrame:
    return df.select("id", "depth", F.concat_ws(",", F.transform("path", lambda e: e.cast("string"))).alias("path"), *more)


@query(f"{_TREE} SELECT id, depth, path FROM t")
def bfs_paths(g: Graph) -> DataFrame:
    return _path(traversal.bfs(g, _START, 2, IN))


@query(f"{_TREE} SELECT CAST(row_number() OVER (ORDER BY depth, e, e2) - 1 AS INTEGER) AS place, id FROM t")
def bfs_visits(g: Graph) -> DataFrame:
    """The order in which a queue meets the nodes: by depth, then by the least edges in turn."""
    order = [r.id for r in traversal.bfs(g, _START, 2, IN).collect()]
    return _rows(g.spark, list(enumerate(order)), "place int, id bigint")


@query(f"{_TREE} SELECT id, depth, path, CAST(row_number() OVER (ORDER BY depth, CASE WHEN depth = 1 THEN -e ELSE e END, -e2) - 1 AS INTEGER) AS seq FROM t")
def dfs_paths(g: Graph) -> DataFrame:
    """A stack: nodes count as met when they are pushed, the last edge first."""
    return _path(traversal.dfs(g, _START, 2, IN), "seq")


@query(f"{_TREE} SELECT id, depth, path FROM t WHERE id IN (SELECT {SUPPLIER} FROM supplier WHERE s_acctbal > 0) AND (e2 >= {13 * KIND} OR depth < 2)")
def bfs_filtered(g: Graph) -> DataFrame:
    """Edge filters prune the way, node filters choose what is returned."""
    return _path(traversal.bfs(g, _START, 2, IN, edge_filter=F.col("label") != "LIVES_IN", node_filter=(F.col("acctbal") > 0) & F.array_contains("labels", "Supplier")))


@query(f"{_TREE} SELECT id, depth FROM t WHERE depth > 0 AND (e2 >= {13 * KIND} OR depth = 1) ORDER BY depth, e, e2 LIMIT 12 OFFSET 2")
def builder_query(g: Graph) -> DataFrame:
    return Traversal(g).start(_START).follow("IN_REGION", "BASED_IN").along(IN).depth(2).offset(3).limit(12).breadth_first().rows().select("id", "depth")


@query(f"SELECT {_id(1, 'r_regionkey')} AS start, 1 + (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) + (SELECT count(*) FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_regionkey = r_regionkey) AS n FROM region")
def together_queries(g: Graph) -> DataFrame:
    starts = [r[0] for r in g.nodes(("Region",), ()).select("id").collect()]
    found = together([Traversal(g).start(s).follow("IN_REGION", "BASED_IN").along(IN).depth(2) for s in starts])
    return _rows(g.spark, [(s, len(x)) for s, x in zip(starts, found, strict=True)], "start bigint, n bigint")


#: The customer with the most orders, and the part that its orders hold most often.
_ENDS = "c AS (SELECT o_custkey AS c FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), p AS (SELECT l_partkey AS p FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN c ON o_custkey = c GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
_BOUGHT = f"WITH {_ENDS}, l AS (SELECT l_orderkey AS o, l_quantity AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, l_partkey AS p FROM lineitem)"


def _bought(g: Graph) -> Graph:
    return Graph(g.spark, {(k,): g.node_tables[k,] for k in ("Customer", "SalesOrder", "Part")}, {k: g.edge_tables[k] for k in ("PLACED", "CONTAINS")})


def _ends(g: Graph) -> tuple[int, int]:
    placed, lines = g.edge_tables["PLACED"], g.edge_tables["CONTAINS"]
    src = placed.groupBy("src").count().orderBy(F.desc("count"), "src").first()[0]
    mine = placed.where(F.col("src") == src).select(F.col("dst").alias("src"))
    return src, lines.join(mine, "src").groupBy("dst").count().orderBy(F.desc("count"), "dst").first()[0]


@query(f"{_BOUGHT} SELECT concat({_id(14, 'o_orderkey')}, ',', {_id(15, f'o_orderkey * CAST({LINES} AS BIGINT) + i')}) AS edges, 2 AS hops FROM orders JOIN c ON o_custkey = c JOIN l ON l.o = o_orderkey JOIN p ON l.p = p.p")
def all_paths_branching(g: Graph) -> DataFrame:
    found = paths.all_paths(_bought(g), *_ends(g), max_depth=3)
    return found.select(F.concat_ws(",", F.transform("edges", lambda e: e.cast("string"))).alias("edges"), "hops")


@query(f"{_BOUGHT} SELECT concat({_id(14, 'o_orderkey')}, ',', {_id(15, f'o_orderkey * CAST({LINES} AS BIGINT) + i')}) AS edges, 2 AS hops, CAST(1 + q AS DOUBLE) AS cost FROM orders JOIN c ON o_custkey = c JOIN l ON l.o = o_orderkey JOIN p ON l.p = p.p ORDER BY q, o_orderkey, i LIMIT 1")
def shortest_weighted_branching(g: Graph) -> DataFrame:
    """The cheapest of several ways: an order costs one, a line its quantity."""
    found = paths.shortest_path_weighted(_bought(g), *_ends(g), weight="quantity", default=1.0)
    return found.select(F.concat_ws(",", F.transform("edges", lambda e: e.cast("string"))).alias("edges"), "hops", "cost")


@query(f"SELECT {REGION} AS dst, r_regionkey = (SELECT n_regionkey FROM nation JOIN customer ON c_nationkey = n_nationkey ORDER BY c_custkey LIMIT 1) AS there FROM region")
def has_paths(g: Graph) -> DataFrame:
    """Whether the first customer is joined to each region."""
    part = _places(g)
    first = part.nodes(("Customer",), ()).agg(F.min("id")).first()[0]
    regions = [r[0] for r in part.nodes(("Region",), ()).select("id").collect()]
    return _rows(g.spark, [(r, paths.has_path(part, first, r)) for r in regions], "dst bigint, there boolean")


def _places(g: Graph) -> Graph:
    return Graph(g.spark, {(k,): g.node_tables[k,] for k in NODES}, {k: g.edge_tables[k] for k in EDGES})


@query(f"SELECT {REGION} AS id, {REGION} AS component FROM region UNION ALL SELECT {NATION}, {_id(1, 'n_regionkey')} FROM nation UNION ALL SELECT {CUSTOMER}, {_id(1, 'n_regionkey')} FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT {SUPPLIER}, {_id(1, 'n_regionkey')} FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def components_of_places(g: Graph) -> DataFrame:
    return paths.connected_components(_places(g))


_LEVEL = "CASE WHEN n_nationkey IN (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier) THEN 1 ELSE 0 END"


@query(f"SELECT {CUSTOMER} AS id, 0 AS level FROM customer UNION ALL SELECT {SUPPLIER}, 0 FROM supplier UNION ALL SELECT {NATION}, {_LEVEL} FROM nation UNION ALL SELECT {REGION}, coalesce((SELECT max(1 + {_LEVEL}) FROM nation WHERE n_regionkey = r_regionkey), 0) FROM region")
def topo_levels_of_places(g: Graph) -> DataFrame:
    return paths.topological_levels(_places(g))


# writes


@on_store(f"SELECT 'Region' AS label, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'IN_REGION', count(*) FROM nation UNION ALL SELECT 'LIVES_IN', count(*) FROM customer UNION ALL SELECT 'BASED_IN', count(*) FROM supplier")
def store_bulk_load(store: Store) -> DataFrame:
    return Store(store.spark, store.path).graph().stats().select("label", "n")


@on_store(f"SELECT 'new' AS name, 0 AS edges, '' AS label UNION ALL SELECT 'tagged', (SELECT count(*) FROM nation), 'Mark:Tag' UNION ALL SELECT 'refused', 0, 'KeyError'")
def store_add(store: Store) -> DataFrame:
    """Nodes without and with labels, an edge to every nation, and an edge to nowhere that is refused."""
    bare, tagged = store.add_node({"name": "new"}), store.add_node({"name": "tagged"}, ["Tag", "Mark"])
    nations = [r[0] for r in store.graph().nodes(("Nation",), ()).select("id").collect()]
    store.add_edges([(tagged, n, "TAGS", {"weight": 1.0}) for n in nations], check=True)
    error = _error(lambda: store.add_edge(bare, 5, "TAGS"))
    g = store.graph()
    counts = g.edges("TAGS").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("edges"))
    new = g.nodes().where(F.col("id") >= bare).join(counts, "id", "left").select("name", F.coalesce("edges", F.lit(0)).alias("edges"), F.array_join("labels", ":").alias("label"))
    return new.unionAll(_rows(store.spark, [("refused", 0, error)], "name string, edges bigint, label string"))


@on_store("SELECT n_name AS name, CASE WHEN n_nationkey = 3 THEN 'changed' END AS comment_, CASE WHEN n_nationkey = 5 THEN NULL ELSE CAST(n_regionkey AS BIGINT) END AS region, CASE WHEN n_nationkey = 6 THEN 'Nation:Seen' WHEN n_nationkey = 7 THEN '' ELSE 'Nation' END AS label FROM nation")
def store_update(store: Store) -> DataFrame:
    at = lambda k: KIND * 2 + 1 + k
    store.update_node(at(3), {"comment_": "changed"})
    store.set_node_props(at(5), {"name": store.graph().node(at(5)).first().name})
    store.add_label(at(6), "Seen")
    store.remove_label(at(7), "Nation")
    nodes = store.graph().nodes().where(F.col("id").between(KIND * 2, KIND * 3))
    return nodes.select("name", "comment_", F.col("regionkey").cast("bigint").alias("region"), F.array_join("labels", ":").alias("label"))


@on_store(f"SELECT {NATION} AS src, {_id(1, 'n_regionkey')} AS dst, CASE WHEN n_nationkey = 3 THEN 2.5 END AS weight FROM nation WHERE n_nationkey <> 4")
def store_edges(store: Store) -> DataFrame:
    store.update_edge(KIND * 11 + 1 + 3, {"weight": 2.5})
    store.delete_edge(KIND * 11 + 1 + 4)
    return store.graph().edges("IN_REGION").select("src", "dst", F.col("weight").cast("decimal(2,1)").alias("weight"))


@on_store("SELECT 'nodes' AS what, count(*) AS n FROM customer WHERE c_nationkey <> 4 UNION ALL SELECT 'edges', count(*) FROM customer WHERE c_nationkey <> 4 UNION ALL SELECT 'nations', count(*) - 1 FROM nation UNION ALL SELECT 'in region', count(*) - 1 FROM nation UNION ALL SELECT 'based', count(*) FROM supplier WHERE s_nationkey <> 4")
def store_cascade(store: Store) -> DataFrame:
    """A nation goes with all its edges, then its customers by a query."""
    customers = [r[0] for r in store.cypher("MATCH (c:Customer {nationkey: 4}) RETURN id(c)").collect()]
    store.delete_node(_FOUR)
    if customers:
        store.cypher("MATCH (c:Customer) WHERE c.nationkey = 4 DELETE c RETURN c.custkey")
    g = store.graph()
    counts = {"nodes": g.nodes(("Customer",), ()), "edges": g.edges("LIVES_IN", ()), "nations": g.nodes(("Nation",), ()), "in region": g.edges("IN_REGION", ()), "based": g.edges("BASED_IN", ())}
    return _rows(store.spark, [(k, df.count()) for k, df in counts.items()], "what string, n bigint")


@on_store("SELECT c_custkey AS custkey, CASE WHEN c_acctbal < 0 THEN 'debt' END AS flag, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS acctbal FROM customer")
def cypher_set(store: Store) -> DataFrame:
    written = store.cypher("MATCH (c:Customer) WHERE c.acctbal < 0 SET c.flag = 'debt', c.acctbal = 0 RETURN c.custkey LIMIT 1")
    assert written.rows.count() <= 1
    nodes = store.graph().nodes(("Customer",))
    return nodes.select("custkey", (F.col("flag") if "flag" in nodes.columns else F.lit(None).cast("string")).alias("flag"), "acctbal")


@on_store("SELECT 'supplier' AS what, s_suppkey AS k FROM supplier WHERE NOT s_acctbal < 0 UNION ALL SELECT 'edge', s_suppkey FROM supplier WHERE NOT s_acctbal < 0")
def cypher_delete(store: Store) -> DataFrame:
    store.cypher("MATCH (s:Supplier)-[r:BASED_IN]->(n) WHERE s.acctbal < 0 DELETE s RETURN s.suppkey")
    g = store.graph()
    return g.nodes(("Supplier",)).select(F.lit("supplier").alias("what"), F.col("suppkey").alias("k")).unionAll(g.edges("BASED_IN").select(F.lit("edge").alias("what"), (F.col("src") - (KIND * 4 + 1)).alias("k")))


@on_store(f"SELECT 'left' AS a, 'JOINS' AS label, 'right' AS b, {_COUNT} + 3 AS nodes UNION ALL SELECT 'right', 'JOINS', 'third', {_COUNT} + 3")
def cypher_create(store: Store) -> DataFrame:
    made = store.cypher("CREATE (a:Tag {name: 'left'})-[:JOINS]->(b:Tag {name: 'right'}), (b)-[:JOINS]->(c:Tag {name: $third}) RETURN a.name", {"third": "third"})
    assert made.stats.nodes_created == 3 and made.stats.edges_created == 2
    return store.cypher("MATCH (a:Tag)-[r:JOINS]->(b:Tag) RETURN a.name, type(r), b.name").toDF("a", "label", "b").withColumn("nodes", F.lit(store.graph().node_count()))


@on_store("SELECT n_name AS name, CASE WHEN n_name = (SELECT min(n_name) FROM nation) THEN 'old' END AS seen, count(*) AS n FROM nation GROUP BY 1 UNION ALL SELECT 'ATLANTIS', 'old', 1")
def cypher_merge(store: Store) -> DataFrame:
    """A node that is there, one that isn't, and that one once more."""
    first = store.graph().nodes(("Nation",)).agg(F.min("name")).first()[0]
    text = "MERGE (n:Nation {name: $name}) ON CREATE SET n.seen = 'new' ON MATCH SET n.seen = 'old' RETURN n.seen"
    seen = [store.cypher(text, {"name": name}).rows.first()[0] for name in (first, "ATLANTIS", "ATLANTIS")]
    assert seen == ["old", "new", "old"]
    return store.graph().nodes(("Nation",)).groupBy("name", "seen").agg(F.count("*").alias("n"))


# constraints, indexes, upkeep


@on_store("SELECT 'UniqueViolation' AS added, 'UniqueViolation' AS declared, count(*) AS n, TRUE AS kept FROM nation")
def unique_guard(store: Store) -> DataFrame:
    """A value that is there is refused, and so is a constraint that doesn't hold."""
    store.create_unique("Nation", "name")
    name = store.graph().nodes(("Nation",)).agg(F.max("name")).first()[0]
    added = _error(lambda: store.add_node({"name": name}, ["Nation"]))
    declared = _error(lambda: store.create_unique("Nation", "regionkey"))
    return _rows(store.spark, [(added, declared, store.graph().nodes(("Nation",), ()).count(), store.unique_constraints() == [("Nation", "name")])], "added string, declared string, n bigint, kept boolean")


@on_store("SELECT 'property' AS how, c_custkey AS custkey FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'two', c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
def index_seeks(store: Store) -> DataFrame:
    store.create_index("mktsegment")
    store.create_index("mktsegment", "nationkey")
    store.reindex()
    assert store.indexes() == [("mktsegment",), ("mktsegment", "nationkey")] and store.has_index("mktsegment")
    g = store.graph()
    store.drop_index("mktsegment")
    assert not store.has_index("mktsegment")
    one, two = g.find_by_property("mktsegment", "BUILDING"), g.find_by_properties({"mktsegment": "BUILDING", "nationkey": 3})
    return one.select(F.lit("property").alias("how"), "custkey").unionAll(two.select(F.lit("two").alias("how"), "custkey"))


@on_store("SELECT c_custkey AS custkey, CASE WHEN c_nationkey < 3 THEN 'low' END AS flag FROM customer WHERE c_nationkey <> 7")
def compacted(store: Store) -> DataFrame:
    """Several writes, then all tables written anew and old versions and files pruned: nothing changes."""
    store.cypher("MATCH (c:Customer) WHERE c.nationkey < 3 SET c.flag = 'low' RETURN c.custkey")
    store.cypher("MATCH (c:Customer) WHERE c.nationkey = 7 DELETE c RETURN c.custkey")
    store.compact(2)
    store.prune(1, unnamed_after=0.0)
    state = store.state()
    assert all(len(parts) == 1 for tables in (state.nodes, state.edges) for parts in tables.values())
    nodes = store.graph().nodes(("Customer",))
    return nodes.select("custkey", (F.col("flag") if "flag" in nodes.columns else F.lit(None).cast("string")).alias("flag"))


@on_store("SELECT 'ReadOnlyError' AS reader, 'QueueFull' AS queue, count(*) AS n FROM region")
def write_guards(store: Store) -> DataFrame:
    reader = _error(lambda: Store(store.spark, store.path, read_only=True).add_node({}))
    narrow, held = Store(store.spark, store.path, queue=1), threading.Event()
    narrow.waiting.acquire()  # as a write that waits does
    queue = _error(lambda: narrow.add_node({}, ["Region"]))
    narrow.waiting.release()
    held.set()
    return _rows(store.spark, [(reader, queue, store.graph().nodes(("Region",), ()).count())], "reader string, queue string, n bigint")


# transactions, snapshots, change records


@on_store("SELECT 'inside' AS seen, count(*) + 2 AS n FROM nation UNION ALL SELECT 'before commit', count(*) FROM nation UNION ALL SELECT 'after commit', count(*) + 2 FROM nation UNION ALL SELECT 'after rollback', count(*) + 2 FROM nation")
def transactions(store: Store) -> DataFrame:
    count = lambda on: on.graph().nodes(("Nation",), ()).count()
    tx = store.begin()
    a, _ = tx.add_nodes([{"name": "A"}, {"name": "B"}], ["Nation"])
    tx.update_node(a, {"name": "A2"})
    assert tx.get_node(a)["name"] == "A2"
    found = [("inside", count(tx)), ("before commit", count(store))]
    tx.commit()
    found.append(("after commit", count(store)))
    tx = store.begin()
    tx.delete_nodes([a])
    tx.rollback()
    found.append(("after rollback", count(store)))
    return _rows(store.spark, found, "seen string, n bigint")


@on_store("SELECT 'snapshot' AS seen, count(*) AS n FROM supplier UNION ALL SELECT 'now', count(*) FROM supplier WHERE s_nationkey <> 4")
def snapshots(store: Store) -> DataFrame:
    snap = store.snapshot()
    store.cypher("MATCH (s:Supplier) WHERE s.nationkey = 4 DELETE s RETURN s.suppkey")
    text = "MATCH (s:Supplier) RETURN s.suppkey"
    return _rows(store.spark, [("snapshot", snap.cypher(text).count()), ("now", store.cypher(text).count())], "seen string, n bigint")


@on_store("SELECT * FROM (VALUES (8, 'add_nodes', 'winner', 'ConflictError'), (9, 'add_nodes', 'later', 'ConflictError')) t(lsn, op, name, loser)")
def change_log(store: Store) -> DataFrame:
    """Of two transactions from one version the one that commits second is refused and leaves no record."""
    one, two = store.begin(), store.begin()
    one.add_node({"name": "winner"})
    two.add_node({"name": "loser"})
    one.commit()
    loser = _error(two.commit)
    store.add_node({"name": "later"})
    return store.changes(7).select("lsn", "op", F.get_json_object("payload", "$.props[0].name").alias("name"), F.lit(loser).alias("loser"))


_FOLLOWED = "SELECT 'Customer' AS label, c_custkey AS k, CASE WHEN c_acctbal < 0 THEN 'debt' END AS flag FROM customer UNION ALL SELECT 'Supplier', s_suppkey, NULL FROM supplier WHERE s_nationkey <> 4 UNION ALL SELECT 'Extra', 1, NULL"


def _written_to(store: Store) -> None:
    store.cypher("MATCH (c:Customer) WHERE c.acctbal < 0 SET c.flag = 'debt' RETURN c.custkey")
    store.cypher("MATCH (s:Supplier) WHERE s.nationkey = 4 DELETE s RETURN s.suppkey")
    store.add_node({"custkey": 1}, ["Extra"])


def _seen_by(store: Store) -> DataFrame:
    nodes = store.graph().nodes().where(F.col("labels")[0].isin("Customer", "Supplier", "Extra"))
    return nodes.select(F.col("labels")[0].alias("label"), F.coalesce("custkey", "suppkey").cast("bigint").alias("k"), (F.col("flag") if "flag" in nodes.columns else F.lit(None).cast("string")).alias("flag"))


@on_store(_FOLLOWED)
def replayed(store: Store) -> DataFrame:
    """A second store after the first one's records, applied in parts, some of them twice."""
    other = Store(store.spark, _place(store.spark, "follower"))
    replay(store.changes(), other)
    _written_to(store)
    assert replay(store.changes(0), other, at_once=2) == 3 and replay(store.changes(0), other) == 0 and other.state().lsn == store.state().lsn
    return _seen_by(other)


@on_store(_FOLLOWED)
def followed(store: Store) -> DataFrame:
    """The same by a stream."""
    _written_to(store)
    other = Store(store.spark, _place(store.spark, "follower"))
    follow(store, other, _place(store.spark, "checkpoint"), once=True).awaitTermination()
    return _seen_by(other)


@on_store("SELECT 1 AS files, 2 AS left_, count(*) + 2 AS n FROM region")
def trimmed_log(store: Store) -> DataFrame:
    """Records that every follower has go; the later ones and the graph stay."""
    for name in ("x", "y"):
        store.add_node({"name": name}, ["Region"])
    files = store.trim(7)
    return _rows(store.spark, [(files, store.changes(7).count(), store.graph().nodes(("Region",), ()).count())], "files int, left_ bigint, n bigint")


@query(f"SELECT {ORDER} AS id FROM orders WHERE o_totalprice > 400000")
def opaque_predicate(g: Graph) -> DataFrame:
    """A filter that only Python knows, as a pandas UDF over batches."""

    @F.pandas_udf("boolean")
    def dear(x: pd.Series) -> pd.Series:
        return x > 400000

    return g.nodes(("SalesOrder",), ("totalprice",)).where(dear(F.col("totalprice").cast("double"))).select("id")


@query(f"SELECT {NATION} AS id, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS degree FROM nation")
def degree_in(g: Graph) -> DataFrame:
    part = Graph(g.spark, {("Nation",): g.node_tables["Nation",]}, {k: g.edge_tables[k] for k in EDGES})
    return adjacency.degree(part, IN)


@query(f"SELECT {_FOUR} AS a, {REGION} AS b, 'IN_REGION' AS label FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_nationkey = 4 UNION ALL SELECT {_FOUR}, {CUSTOMER}, 'LIVES_IN' FROM customer WHERE c_nationkey = 4 UNION ALL SELECT {_FOUR}, {SUPPLIER}, 'BASED_IN' FROM supplier WHERE s_nationkey = 4")
def all_edges_of(g: Graph) -> DataFrame:
    return adjacency.incident(g, _FOUR, BOTH).select(F.col("node").alias("a"), F.col("other").alias("b"), "label")
