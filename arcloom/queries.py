"""The graph queries of the entry module, and the same results in SQL over the plain tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcloom.model import BOTH, IN, OUT, Graph
from arcloom.operators import adjacency, constraints, pages, paths, traversal
from arcloom.operators.sized import dealt
from arcloom.sources.tables import KIND, tables_graph

FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None):
    """Register a function of (graph) under its name, with its SQL."""

    def add(f):
        FOUND[f.__name__] = (lambda spark, sf_dir: f(tables_graph(spark, sf_dir)), sql)
        return f

    return add


def cypher(name: str, text: str, columns: str, sql: str | None, **params) -> None:
    """Register a query of the language; dotted names become plain ones."""
    FOUND[name] = (lambda spark, sf_dir: tables_graph(spark, sf_dir).cypher(text, params).toDF(*columns.split()), sql)


def _id(kind: int, key: str) -> str:
    return f"{kind * KIND + 1} + {key}"


CUSTOMER, ORDER, NATION, REGION, PART, SUPPLIER = (_id(k, c) for k, c in ((3, "c_custkey"), (5, "o_orderkey"), (2, "n_nationkey"), (1, "r_regionkey"), (6, "p_partkey"), (4, "s_suppkey")))
_NEXT = "SELECT o_orderkey AS a, lead(o_orderkey) OVER w AS b, date_diff('day', CAST(o_orderdate AS DATE), CAST(lead(o_orderdate) OVER w AS DATE)) AS gap FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
#: An order's place in its customer's chain.
_CHAIN = "SELECT o_orderkey AS k, o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders"

# scans and seeks

cypher("node_scan_label", "MATCH (c:Customer) RETURN c.custkey, c.name, c.acctbal", "custkey name acctbal", "SELECT c_custkey AS custkey, c_name AS name, c_acctbal AS acctbal FROM customer")
cypher("node_scan_whole", "MATCH (r:Region) RETURN r.name, id(r)", "name node", f"SELECT r_name AS name, {REGION} AS node FROM region")
cypher("prop_eq", "MATCH (c:Customer) WHERE c.mktsegment = 'BUILDING' RETURN c.custkey", "custkey", "SELECT c_custkey AS custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
cypher("prop_inline", "MATCH (o:SalesOrder {orderstatus: 'F', orderpriority: '1-URGENT'}) RETURN o.orderkey", "orderkey", "SELECT o_orderkey AS orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
cypher("prop_param", "MATCH (p:Part {size: $size}) WHERE p.retailprice > $price RETURN p.partkey, p.name", "partkey name", "SELECT p_partkey AS partkey, p_name AS name FROM part WHERE p_size = 10 AND p_retailprice > 920", size=10, price=920)
cypher("where_and_or_not", "MATCH (c:Customer) WHERE c.acctbal > 5000 AND NOT c.mktsegment = 'BUILDING' OR c.nationkey = 3 RETURN c.custkey", "custkey", "SELECT c_custkey AS custkey FROM customer WHERE (c_acctbal > 5000 AND c_mktsegment <> 'BUILDING') OR c_nationkey = 3")
cypher("where_lt_nulls", "MATCH (n) WHERE n.acctbal < 0 RETURN id(n)", "node", f"""
    SELECT {CUSTOMER} AS node FROM customer WHERE c_acctbal < 0 OR c_acctbal IS NULL UNION ALL SELECT {SUPPLIER} FROM supplier WHERE s_acctbal < 0 OR s_acctbal IS NULL
    UNION ALL SELECT {REGION} FROM region UNION ALL SELECT {NATION} FROM nation UNION ALL SELECT {ORDER} FROM orders UNION ALL SELECT {PART} FROM part
    UNION ALL SELECT DISTINCT {_id(7, "user_id")} FROM events WHERE user_id IS NOT NULL UNION ALL SELECT {_id(8, "event_id")} FROM events""")  # fmt: skip
cypher("where_neq_nulls", "MATCH (n:Event) WHERE n.kind <> 'click' RETURN n.event_id", "event_id", "SELECT event_id FROM events WHERE event_type IS DISTINCT FROM 'click'")
cypher("where_text_order", "MATCH (n:Nation) WHERE n.name >= 'J' AND n.name < 'S' RETURN n.name", "name", "SELECT n_name AS name FROM nation WHERE n_name >= 'J' AND n_name < 'S'")
cypher("where_mixed_types", "MATCH (n:Nation) WHERE n.nationkey < '2' RETURN n.nationkey", "nationkey", "SELECT n_nationkey AS nationkey FROM nation WHERE CAST(n_nationkey AS VARCHAR) < '2'")
cypher("where_truth", "MATCH (n:Nation) WHERE n.nationkey RETURN n.name", "name", "SELECT n_name AS name FROM nation WHERE n_nationkey <> 0")

# one hop

cypher("hop_out", "MATCH (c:Customer)-[:PLACED]->(o:SalesOrder) WHERE o.totalprice > 200000 RETURN c.name, o.orderkey, o.totalprice", "name orderkey totalprice", "SELECT c_name AS name, o_orderkey AS orderkey, o_totalprice AS totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 200000")
cypher("hop_in", "MATCH (o:SalesOrder)<-[:PLACED]-(c:Customer {mktsegment: 'MACHINERY'}) RETURN o.orderkey, c.custkey", "orderkey custkey", "SELECT o_orderkey AS orderkey, c_custkey AS custkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'MACHINERY'")
cypher("hop_both", "MATCH (a:SalesOrder {orderstatus: 'P'})-[:NEXT]-(b) RETURN id(a), id(b)", "a b", f"WITH n AS ({_NEXT}), e AS (SELECT a, b FROM n WHERE b IS NOT NULL UNION ALL SELECT b, a FROM n WHERE b IS NOT NULL) SELECT {_id(5, 'e.a')} AS a, {_id(5, 'e.b')} AS b FROM e JOIN orders o ON o.o_orderkey = e.a WHERE o_orderstatus = 'P'")
cypher("hop_anytype_typefn", "MATCH (n:Nation)-[r]-(x) RETURN n.name, type(r), id(x)", "name label node", f"""
    SELECT n_name AS name, 'IN_REGION' AS label, {_id(1, "n_regionkey")} AS node FROM nation UNION ALL SELECT n_name, 'LIVES_IN', {CUSTOMER} FROM nation JOIN customer ON c_nationkey = n_nationkey
    UNION ALL SELECT n_name, 'BASED_IN', {SUPPLIER} FROM nation JOIN supplier ON s_nationkey = n_nationkey""")  # fmt: skip
cypher("hop_b_label", "MATCH (x {nationkey: 5})<-[]-(s:Supplier) RETURN id(x), s.suppkey", "node suppkey", f"SELECT {_id(2, 's_nationkey')} AS node, s_suppkey AS suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_nationkey = 5")
cypher("hop_edge_prop", "MATCH (o:SalesOrder)-[r:CONTAINS]->(p:Part) WHERE r.quantity >= 50 AND r.returnflag = 'R' RETURN o.orderkey, p.partkey, r.extendedprice", "orderkey partkey price", "SELECT l_orderkey AS orderkey, l_partkey AS partkey, l_extendedprice AS price FROM lineitem WHERE l_quantity >= 50 AND l_returnflag = 'R'")
cypher("hop_chain", "MATCH (r:Region {name: 'ASIA'})<-[:IN_REGION]-(n:Nation)<-[:LIVES_IN]-(c:Customer) RETURN n.name, c.custkey", "name custkey", "SELECT n_name AS name, c_custkey AS custkey FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE r_name = 'ASIA'")

# order, skip, limit

cypher("topk_desc", "MATCH (c:Customer)-[:PLACED]->(o:SalesOrder) RETURN c.name, o.totalprice ORDER BY o.totalprice DESC LIMIT 10", "name totalprice", "SELECT c_name AS name, o_totalprice AS totalprice FROM customer JOIN orders ON c_custkey = o_custkey ORDER BY o_totalprice DESC, c_custkey, o_orderkey LIMIT 10")
cypher("order_full", "MATCH (n:Nation) RETURN n.name ORDER BY n.regionkey DESC", "name", "SELECT n_name AS name FROM nation ORDER BY n_regionkey DESC, n_nationkey")
cypher("skip_limit", "MATCH (p:Part) RETURN p.partkey, p.retailprice ORDER BY p.retailprice SKIP 5 LIMIT 20", "partkey retailprice", "SELECT p_partkey AS partkey, p_retailprice AS retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 20 OFFSET 5")
cypher("alias_order", "MATCH (s:Supplier) RETURN s.suppkey AS k, s.acctbal AS balance ORDER BY balance DESC LIMIT 7", "k balance", "SELECT s_suppkey AS k, s_acctbal AS balance FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 7")

# optional

cypher("optional_match", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o) WHERE o.totalprice > 300000 RETURN c.custkey, o.orderkey", "custkey orderkey", "SELECT c_custkey AS custkey, o_orderkey AS orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000")
cypher("optional_where", "MATCH (n:Nation) WHERE n.regionkey = 2 OPTIONAL MATCH (n)<-[:BASED_IN]-(s:Supplier) WHERE s.acctbal > 9000 RETURN n.name, s.suppkey, s.acctbal", "name suppkey acctbal", "SELECT n_name AS name, s_suppkey AS suppkey, s_acctbal AS acctbal FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9000 WHERE n_regionkey = 2")
cypher("optional_node", "MATCH (r:Region) OPTIONAL MATCH (n:Nation {nationkey: 3}) RETURN r.name, n.name", "region nation", "SELECT r_name AS region, n_name AS nation FROM region LEFT JOIN nation ON n_nationkey = 3")

# several hops

for _least, _most in ((1, 3), (2, 3), (0, 2)):
    cypher(f"varlen_{_least}_{_most}", f"MATCH (a:SalesOrder {{orderpriority: '2-HIGH'}})-[:NEXT*{_least}..{_most}]->(b) RETURN id(a), id(b)", "a b",
        f"WITH c AS ({_CHAIN}) SELECT {_id(5, 'x.k')} AS a, {_id(5, 'y.k')} AS b FROM c x JOIN orders ON o_orderkey = x.k JOIN c y ON x.c = y.c AND y.i - x.i BETWEEN {_least} AND {_most} WHERE o_orderpriority = '2-HIGH'")
cypher("varlen_region", "MATCH (c:Customer {nationkey: 7})-[*2..2]->(r:Region) RETURN c.custkey, r.name", "custkey name", "SELECT c_custkey AS custkey, r_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_nationkey = 7")


@query(f"WITH c AS ({_CHAIN}), s AS (SELECT * FROM c WHERE k = (SELECT min(k) FROM c WHERE i = 1)) SELECT {_id(5, 's.k')} AS start, {_id(5, 'y.k')} AS id, CAST(y.i - s.i AS INTEGER) AS depth FROM s JOIN c y ON y.c = s.c AND y.i - s.i BETWEEN 0 AND 4")
def bfs_depth(g: Graph) -> DataFrame:
    edges = g.edges("NEXT", ())
    first = g.nodes(("SalesOrder",), ()).select("id").join(edges.select(F.col("dst").alias("id")), "id", "left_anti").agg(F.min("id")).first()[0]
    return traversal.bfs(g, first, 4, labels=["NEXT"]).select("start", "id", "depth")


@query(None)
def dfs_order(g: Graph) -> DataFrame:
    return traversal.dfs(g, KIND * 2 + 1, 2, BOTH, labels=["IN_REGION", "BASED_IN"])


_ENDS = f"WITH c AS ({_CHAIN}), f AS (SELECT c FROM c GROUP BY c HAVING count(*) >= 4 ORDER BY c LIMIT 1), p AS (SELECT k, i FROM c JOIN f USING (c) WHERE i <= 4)"


def _chain_ends(g: Graph) -> tuple[int, int]:
    """The first and the fourth order of the first customer that has four."""
    from pyspark.sql.window import Window

    links = g.edge_tables["PLACED"].join(g.node_tables["SalesOrder",].select("id", "orderdate", "orderkey").withColumnRenamed("id", "dst"), "dst")
    place = F.row_number().over(Window.partitionBy("src").orderBy("orderdate", "orderkey"))
    rows = links.select("src", "dst", place.alias("i")).where("i IN (1, 4)").groupBy("src").agg(F.max(F.when(F.col("i") == 1, F.col("dst"))).alias("a"), F.max(F.when(F.col("i") == 4, F.col("dst"))).alias("b")).where("b IS NOT NULL").orderBy("src").first()
    return rows["a"], rows["b"]


@query(f"{_ENDS} SELECT {_id(5, 'a.k')} AS src, {_id(5, 'b.k')} AS dst, 3 AS hops, CAST(3 AS DOUBLE) AS cost FROM p a, p b WHERE a.i = 1 AND b.i = 4")
def shortest_path(g: Graph) -> DataFrame:
    return paths.shortest_path(g, *_chain_ends(g), label="NEXT").select("src", "dst", "hops", "cost")


@query(f"{_ENDS}, n AS ({_NEXT}) SELECT {_id(5, 'a.k')} AS src, {_id(5, 'b.k')} AS dst, 3 AS hops, CAST((SELECT sum(gap) FROM n WHERE n.a IN (SELECT k FROM p WHERE i <= 3)) AS DOUBLE) AS cost FROM p a, p b WHERE a.i = 1 AND b.i = 4")
def shortest_weighted(g: Graph) -> DataFrame:
    return paths.shortest_path_weighted(g, *_chain_ends(g), weight="gap_days", label="NEXT").select("src", "dst", "hops", "cost")


@query(f"{_ENDS} SELECT {_id(5, 'a.k')} AS src, {_id(5, 'b.k')} AS dst, 3 AS hops FROM p a, p b WHERE a.i = 1 AND b.i = 4")
def all_paths(g: Graph) -> DataFrame:
    return paths.all_paths(g, *_chain_ends(g), max_depth=5, label="NEXT").select("src", "dst", "hops")


@query("SELECT TRUE AS there, FALSE AS back")
def has_path(g: Graph) -> DataFrame:
    a, b = _chain_ends(g)
    return g.spark.createDataFrame([(paths.has_path(g, a, b, "NEXT"), paths.has_path(g, b, a, "NEXT"))], "there boolean, back boolean")


def _orders(g: Graph) -> Graph:
    return Graph(g.spark, {("SalesOrder",): g.node_tables["SalesOrder",]}, {"NEXT": g.edge_tables["NEXT"]})


@query(f"SELECT {ORDER} AS id, {_id(5, 'min(o_orderkey) OVER (PARTITION BY o_custkey)')} AS component FROM orders")
def components(g: Graph) -> DataFrame:
    return paths.connected_components(_orders(g), "NEXT")


@query(f"WITH c AS ({_CHAIN}) SELECT {_id(5, 'k')} AS id, CAST(i - 1 AS INTEGER) AS level FROM c")
def topo_levels(g: Graph) -> DataFrame:
    return paths.topological_levels(_orders(g), "NEXT")


# adjacency

_FIRST = KIND * 2 + 1 + 4


@query(f"SELECT {_id(12, 'c_custkey')} AS id, {CUSTOMER} AS src, 'LIVES_IN' AS label FROM customer WHERE c_nationkey = 4 UNION ALL SELECT {_id(13, 's_suppkey')}, {SUPPLIER}, 'BASED_IN' FROM supplier WHERE s_nationkey = 4")
def in_edges(g: Graph) -> DataFrame:
    return adjacency.edges_of(g, _FIRST, IN).select("id", "src", "label")


@query(f"SELECT {_id(11, 'n_nationkey')} AS id, {_id(1, 'n_regionkey')} AS dst, 'IN_REGION' AS label FROM nation WHERE n_nationkey = 4")
def out_edges(g: Graph) -> DataFrame:
    return adjacency.edges_of(g, _FIRST).select("id", "dst", "label")


@query(f"SELECT {CUSTOMER} AS id, c_name AS name FROM customer WHERE c_nationkey = 4 UNION ALL SELECT {SUPPLIER}, s_name FROM supplier WHERE s_nationkey = 4 UNION ALL SELECT {REGION}, r_name FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_nationkey = 4")
def neighbors(g: Graph) -> DataFrame:
    return adjacency.neighbors(g, _FIRST, BOTH).select("id", "name")


@query(f"SELECT {ORDER} AS id, coalesce(n, 0) AS degree FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def degree_out(g: Graph) -> DataFrame:
    part = Graph(g.spark, {("SalesOrder",): g.node_tables["SalesOrder",]}, {"CONTAINS": g.edge_tables["CONTAINS"]})
    return adjacency.degree(part, OUT, "CONTAINS")


@query(f"SELECT {NATION} AS id, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) + 1 AS degree FROM nation")
def degree_both(g: Graph) -> DataFrame:
    part = Graph(g.spark, {("Nation",): g.node_tables["Nation",]}, {k: g.edge_tables[k] for k in ("IN_REGION", "LIVES_IN", "BASED_IN")})
    return adjacency.degree(part, BOTH)


def _asked(g: Graph) -> DataFrame:
    """Each supplier with each part that it supplies and with the part after it, which it mostly doesn't."""
    pairs = g.edges("SUPPLIES", ()).select("src", "dst")
    return dealt(pairs.unionAll(pairs.select("src", F.col("dst") + 1)), "src", "dst").distinct()


def has_edge_all(g: Graph) -> DataFrame:
    return adjacency.having_edge(g, _asked(g), "SUPPLIES").select("src", "dst")


FOUND["has_edge_all"] = (lambda spark, sf_dir: has_edge_all(tables_graph(spark, sf_dir)), f"SELECT DISTINCT {_id(4, 'l_suppkey')} AS src, {_id(6, 'l_partkey')} AS dst FROM lineitem WHERE l_suppkey IS NOT NULL AND l_partkey IS NOT NULL")


@query(f"SELECT {_FIRST} AS id UNION ALL SELECT {CUSTOMER} FROM customer WHERE c_nationkey = 4 UNION ALL SELECT {SUPPLIER} FROM supplier WHERE s_nationkey = 4 UNION ALL SELECT {_id(1, 'n_regionkey')} FROM nation WHERE n_nationkey = 4")
def neighborhood(g: Graph) -> DataFrame:
    return adjacency.neighborhood(g, _FIRST)[0].select("id")


@query(f"SELECT {_id(11, 'n_nationkey')} AS id FROM nation WHERE n_regionkey = 1")
def subgraph_edges(g: Graph) -> DataFrame:
    ids = g.nodes(("Nation",), ("regionkey",)).where("regionkey = 1").select("id").unionAll(g.nodes(("Region",), ()).select("id"))
    return adjacency.subgraph(g, ids)[1].select("id")


@query("SELECT 'PLACED' AS label, count(*) AS n FROM orders UNION ALL SELECT 'CONTAINS', count(*) FROM lineitem UNION ALL SELECT 'DID', count(*) FROM events WHERE user_id IS NOT NULL")
def edge_type_scan(g: Graph) -> DataFrame:
    return g.stats().where("kind = 'edge' AND label IN ('PLACED', 'CONTAINS', 'DID')").select("label", "n")


@query("SELECT 'Customer' AS label, count(*) AS n FROM customer UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'User', count(DISTINCT user_id) FROM events")
def node_counts(g: Graph) -> DataFrame:
    return g.stats().where("kind = 'node' AND label IN ('Customer', 'Part', 'User')").select("label", "n")


# pages, constraints, integrity


@query(f"SELECT id FROM (SELECT {CUSTOMER} AS id FROM customer UNION ALL SELECT {SUPPLIER} FROM supplier UNION ALL SELECT {ORDER} FROM orders) WHERE id > {3 * KIND + 100} ORDER BY id LIMIT 50")
def page_nodes(g: Graph) -> DataFrame:
    return pages.list_nodes(g, 3 * KIND + 100, 50).items.select("id")


@query(f"SELECT {_id(14, 'o_orderkey')} AS id FROM orders WHERE {_id(14, 'o_orderkey')} > {14 * KIND + 20} ORDER BY 1 LIMIT 25")
def page_edges(g: Graph) -> DataFrame:
    return pages.list_edges(g, 14 * KIND + 20, 25, "PLACED").items.select("id")


@query(f"SELECT {PART} AS id, p_name AS name FROM part ORDER BY 1 LIMIT 10 OFFSET 30")
def page_label(g: Graph) -> DataFrame:
    return pages.by_offset(g.nodes(("Part",), ("name",)), 10, 30).select("id", "name")


@query("SELECT CAST(o_custkey AS VARCHAR) AS value, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def unique_violations(g: Graph) -> DataFrame:
    return constraints.violations(g, "SalesOrder", "custkey")


@query("SELECT 'repeated node ids' AS check_name, 0 AS violations UNION ALL SELECT 'repeated edge ids', 0 UNION ALL SELECT 'dangling edges', 0")
def verify_integrity(g: Graph) -> DataFrame:
    return adjacency.verify(g)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in FOUND.items() if sql}
