import random
from collections import deque
import heapq

import pytest
from graphs import graph
from pyspark.sql import functions as F

from arcloom.builder import Traversal, together
from arcloom.model import BOTH, IN, OUT, Graph
from arcloom.operators import adjacency, pages, paths
from arcloom.operators.traversal import bfs, dfs


def names(g, df):
    by = {r.id: r.name for r in g.nodes().collect()}
    return "".join(by[r.id] for r in df.collect())


def chain(spark, pairs, label="connects", extra=()):
    nodes = sorted({x for p in pairs for x in p[:2]} | set(extra))
    return graph(spark, nodes, [(p[0], p[1], *([label] if len(p) == 2 else p[2:])) for p in pairs])


@pytest.fixture(scope="module")
def five(spark):
    return chain(spark, ["AB", "BC", "CD", "BE", "ED"])


def test_bfs(five):
    assert names(five, bfs(five, 1)) == "ABCED" and bfs(five, 1, 1).count() == 2 and bfs(five, 1, 2).count() == 4
    assert bfs(five, 1).where("id = 4").first().path == [1, 2, 3]
    assert names(five, bfs(five, 4, direction=IN, max_depth=1)) == "DCE"
    assert names(five, bfs(five, 1, edge_filter=F.col("id") != 2)) == "ABED"
    assert names(five, bfs(five, 1, node_filter=F.col("name").isin("A", "D"))) == "AD"
    with pytest.raises(KeyError):
        bfs(five, 99)


def test_dfs(spark):
    g = chain(spark, ["AB", "AC", "BD", "CE"])
    assert names(g, dfs(g, 1)) == "ACBDE"


def test_builder(spark):
    g = graph(spark, [("Aro", {"depth": 11.5}), ("Brel", {"depth": 7.0}), ("Cass", {"depth": 19.0}), "cargo"], [("Aro", "Brel", "sails"), ("Aro", "Cass", "sails"), ("Brel", "Cass", "sails"), ("Aro", "cargo", "loads")])
    t = Traversal(g).start(1).follow("sails")
    assert t.depth(1).rows().count() == 3 and t.depth(2).where(F.col("depth") > 12).nodes().first().name == "Cass"
    assert [r.id for r in t.offset(1).limit(1).rows().collect()] == [2] and t.in_depth().rows().first().id == 1
    assert [len(x) for x in together([t.depth(1), t.depth(0), lambda: "xy"])] == [3, 1, 2]
    with pytest.raises(ValueError):
        Traversal(g).rows()


def test_paths(spark):
    g = graph(spark, "A B C D".split(), [("A", "B", "road"), ("B", "C", "road"), ("C", "D", "road"), ("A", "D", "highway")])
    assert paths.shortest_path(g, 1, 4).first().edges == [4] and paths.shortest_path(g, 1, 4, "road").first().hops == 3
    assert paths.has_path(g, 1, 4) and not paths.has_path(g, 4, 1) and paths.shortest_path(g, 2, 2).first().hops == 0
    g = graph(spark, "A B C D".split(), [("A", "B", "road"), ("B", "D", "road"), ("A", "C", "road"), ("C", "D", "road")])
    assert sorted(r.nodes for r in paths.all_paths(g, 1, 4, 5).collect()) == [[1, 2, 4], [1, 3, 4]] and paths.all_paths(g, 1, 1).first().hops == 0


def test_d5_true_cost(spark):
    w = lambda x: {"weight": float(x)}
    g = graph(spark, "A B C D".split(), [("A", "B", "road", w(1)), ("B", "D", "road", w(1)), ("A", "C", "road", w(5)), ("C", "D", "road", w(1)), ("A", "D", "road", w(10))])
    r = paths.shortest_path_weighted(g, 1, 4).first()
    assert (r.nodes, r.hops, r.cost) == ([1, 2, 4], 2, 2.0)


def test_components_and_order(spark):
    g = chain(spark, ["AB", "BC", "DE"], extra="F")
    assert sorted(tuple(r) for r in paths.connected_components(g).collect()) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6)]
    g = chain(spark, ["AB", "AC", "BD", "CD"], "dep")
    assert [(r.id, r.level) for r in paths.topological_sort(g).collect()] == [(1, 0), (2, 1), (3, 1), (4, 2)]
    for loop in (["AB", "BA"], ["AA"]):
        with pytest.raises(paths.CycleError):
            paths.topological_sort(chain(spark, loop))


def test_adjacency(spark):
    g = chain(spark, ["AB", "AC", "BA", "AA"])
    degree = lambda d: {r.id: r.degree for r in adjacency.degree(g, d).collect()}
    assert degree(OUT) == {1: 3, 2: 1, 3: 0} and degree(IN) == {1: 2, 2: 1, 3: 1} and degree(BOTH)[1] == 5
    assert [r.id for r in adjacency.edges_of(g, 1, BOTH).collect()] == [1, 2, 4, 3, 4]
    assert sorted(r.id for r in adjacency.neighbors(g, 1, BOTH).collect()) == [1, 2, 3]
    assert adjacency.has_edge(g, 1, 2) and not adjacency.has_edge(g, 3, 1) and not adjacency.has_edge(g, 1, 2, "x")
    nodes, edges = adjacency.neighborhood(g, 2)
    assert nodes.count() == 2 and edges.count() == 2
    g = graph(spark, "A B C T".split(), [("A", "B", "f"), ("A", "C", "f"), ("A", "C", "f"), ("A", "T", "c")])
    assert adjacency.neighbors(g, 1, label="f").count() == 3 and adjacency.neighbors(g, 1, label="c").count() == 1 and g.edges("f").count() == 3


def test_dangling(spark):
    g = Graph.of_rows(spark, [(1, (), {"n": 1})], [(1, 1, 9, "x", {}), (2, 1, 1, "x", {})])
    assert [r.id for r in adjacency.dangling_edges(g).collect()] == [1]
    assert {r.check_name: r.violations for r in adjacency.verify(g).collect()} == {"repeated node ids": 0, "repeated edge ids": 0, "dangling edges": 1}
    assert [r.id for r in bfs(g, 1).collect()] == [1]


def test_d19_pages(spark):
    g = Graph.of_rows(spark, [(i, ("A" if i % 2 else "B",), {"v": i}) for i in range(1, 16)], [(i, i, i + 1, "NEXT", {}) for i in range(1, 15)])
    cursor, seen, sizes = 0, [], []
    while True:
        p = pages.list_nodes(g, cursor, 5)
        ids = [r.id for r in p.items.collect()]
        seen += ids
        sizes.append(len(ids))
        cursor = p.cursor
        if not p.more:
            break
    assert sizes == [5, 5, 5] and seen == list(range(1, 16)) and cursor == 0
    assert [r.id for r in pages.list_nodes(g, 3, 2, "A").items.collect()] == [5, 7] and pages.list_edges(g, 0, 0).items.count() == 14
    assert [r.id for r in pages.by_offset(g.nodes(), 3, 4).collect()] == [5, 6, 7]


# random multigraphs against a queue, a stack and a heap


def random_graph(seed):
    rng = random.Random(seed)
    n = rng.randint(3, 8)
    return n, [(i, rng.randint(1, n), rng.randint(1, n), rng.randint(0, 5)) for i in range(1, rng.randint(4, 20))]


def around(edges, node, direction):
    out = [(0, i, b) for i, a, b, _ in edges if a == node] if direction != IN else []
    back = [(1, i, a) for i, a, b, _ in edges if b == node] if direction != OUT else []
    return [(i, x) for _, i, x in sorted(out + back)]


def by_queue(edges, start, depth, direction):
    seen, todo, out = {start}, deque([(start, 0, [])]), []
    while todo:
        n, d, p = todo.popleft()
        out.append((n, d, p))
        if d == depth:
            continue
        for i, x in around(edges, n, direction):
            if x not in seen:
                seen.add(x)
                todo.append((x, d + 1, [*p, i]))
    return out


def by_stack(edges, start, depth, direction):
    out, seen, stack = [(start, 0, [])], {start}, [(start, 0, [])]
    while stack:
        n, d, p = stack.pop()
        if d == depth:
            continue
        for i, x in around(edges, n, direction)[::-1]:
            if x not in seen:
                seen.add(x)
                out.append((x, d + 1, [*p, i]))
                stack.append(out[-1])
    return out


def by_heap(edges, start):
    cost, heap = {}, [(0, start)]
    while heap:
        c, n = heapq.heappop(heap)
        if n not in cost:
            cost[n] = c
            for _, a, b, w in edges:
                if a == n:
                    heapq.heappush(heap, (c + w, b))
    return cost


@pytest.mark.parametrize("seed, direction, depth", [(1, OUT, -1), (2, BOTH, -1), (3, IN, 2), (4, BOTH, 3)])
def test_random(spark, seed, direction, depth):
    n, edges = random_graph(seed)
    g = Graph.of_rows(spark, [(i, (), {}) for i in range(1, n + 1)], [(i, a, b, "e", {"weight": float(w)}) for i, a, b, w in edges])
    rows = lambda df: [(r.id, r.depth, r.path) for r in df.collect()]
    assert rows(bfs(g, 1, depth, direction)) == by_queue(edges, 1, depth, direction)
    assert rows(dfs(g, 1, depth, direction)) == by_stack(edges, 1, depth, direction)
    assert {r.id: r.cost for r in paths.cheapest(g, 1, "weight").collect()} == by_heap(edges, 1)
    root = list(range(n + 1))
    for _ in range(n):
        for _, a, b, _ in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert {r.id: r.component for r in paths.connected_components(g).collect()} == dict(enumerate(root[1:], 1))


def test_has_edge_asks_about_all_parts(spark):
    from arcloom import queries
    from arcloom.sources.tables import KIND, tables_graph

    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", "l_partkey").distinct().collect()
    edges = {(4 * KIND + 1 + r.l_suppkey, 6 * KIND + 1 + r.l_partkey) for r in rows}
    asked = {tuple(r) for r in queries._asked(tables_graph(spark, d)).collect()}
    assert edges < asked and {(s, p + 1) for s, p in edges} <= asked
    found = queries.queries()["has_edge_all"](spark, d)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == edges
    assert "Cartesian" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan


def test_ids_of_large_keys_never_meet(spark, tmp_path):
    """Order keys from 10^6 and 10^9 on, suppliers and parts to match: no two edges share an id, and a key that is too large raises."""
    from arcloom.sources.tables import PARTS, tables_graph

    orders = [(k, 1, "O", 1.0, f"2020-01-0{i + 1}") for i, k in enumerate((5, 10**6, 10**6 + 1, 10**9, 10**9 + 1, 10**12))]
    lines = [(k, n, p, s) for k, *_ in orders for n, p, s in ((1, 7, 9), (2, 10**6 + 7, 8), (3, 7, 10**3 + 9), (4, 3 * 10**9, 6 * 10**7))]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate string").write.parquet(str(tmp_path / "orders.parquet"))
    of_lines = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string"
    spark.createDataFrame([(*x, 1.0, 1.0, 0.0, "N") for x in lines], of_lines).write.parquet(str(tmp_path / "lineitem.parquet"))
    g = tables_graph(spark, str(tmp_path))
    some = Graph(spark, {}, {k: g.edge_tables[k] for k in ("PLACED", "CONTAINS", "SUPPLIES", "NEXT")})
    edges = some.edges(columns=()).collect()
    assert len({r.id for r in edges}) == len(edges) == 6 + 24 + 4 + 5 and all(r.id > 0 for r in edges)
    (tmp_path / "far").mkdir()
    spark.createDataFrame([(1, 1, PARTS, 3, 1.0, 1.0, 0.0, "N")], of_lines).write.parquet(str(tmp_path / "far" / "lineitem.parquet"))
    with pytest.raises(Exception, match="too large"):
        tables_graph(spark, str(tmp_path / "far")).edges("SUPPLIES").collect()


def test_opaque_predicate(spark):
    """A filter by a pandas UDF runs and takes the rows that its SQL takes."""
    from arcloom import operations

    d = "/root/testdata/sf0.01"
    spark.read.parquet(f"{d}/orders.parquet").createOrReplaceTempView("orders")
    run, sql = operations.FOUND["opaque_predicate"]
    out = run(spark, d)
    assert out.columns == ["id"] and sorted(map(tuple, out.collect())) == sorted(map(tuple, spark.sql(sql).collect())) != []


def nodes_of(spark, path, n):
    spark.range(n).write.parquet(path)
    return spark.read.parquet(path)


def test_tasks_follow_the_size(spark, tmp_path, monkeypatch):
    """Ids compress well; nevertheless they are dealt to as many tasks as the tables' size asks for, and the walks stay right."""
    from arcloom.operators import sized

    known = nodes_of(spark, str(tmp_path / "ids"), 300_000)
    monkeypatch.setattr(sized, "PART", 100_000)
    n = sized.parts(known, known)
    gone = sized.absent(known.select((F.col("id") + 150_000).alias("id")), known)
    assert n > 20 and len(gone.inputFiles()) == n and sorted(r.id for r in gone.collect()) == list(range(300_000, 450_000))
    chain = Graph(spark, {"N": known}, {"e": spark.createDataFrame([(1, 5, 6), (2, 6, 7), (3, 5, 400_000), (4, 400_000, 8), (5, 7, None)], "id bigint, src bigint, dst bigint")})
    for few in (0, 10):
        monkeypatch.setattr(sized, "FEW", few)
        assert [(r.id, r.path) for r in dfs(chain, 5).collect()] == [(r.id, r.path) for r in bfs(chain, 5).collect()] == [(5, []), (6, [1]), (7, [1, 2])]
        assert sorted(r.id for r in paths.cheapest(chain, 5, "weight").collect()) == [5, 6, 7]


def test_reach_over_repeated_links(spark, monkeypatch):
    """Links are followed as they are, repeated ones too, whether the frontier is sent to them or both are dealt."""
    from arcloom.operators import sized
    from arcloom.operators.traversal import reach
    from arcloom.sources.tables import tables_graph

    edges = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate([(1, 2), (1, 2), (2, 3), (2, 3), (3, 1), (3, 4)])], "id bigint, src bigint, dst bigint")
    for few in (0, 10):
        monkeypatch.setattr(sized, "FEW", few)
        assert sorted(tuple(r) for r in reach(edges, spark.createDataFrame([(1,), (3,)], "start bigint"), 2).collect()) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (3, 1, 1), (3, 2, 2), (3, 3, 0), (3, 4, 1)]
    pairs = tables_graph(spark, "/root/testdata/sf0.001").edges("SUPPLIES", ())
    assert "REPARTITION_BY_NUM" in pairs._jdf.queryExecution().executedPlan().toString()


def test_has_edge_in_as_many_tasks_as_the_size_asks_for(spark, monkeypatch):
    from arcloom import queries
    from arcloom.operators import sized

    monkeypatch.setattr(sized, "PART", 2_000)
    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", "l_partkey").distinct().count()
    found = queries.queries()["has_edge_all"](spark, d)
    assert found.rdd.getNumPartitions() > 10 and found.count() == found.distinct().count() == rows


def test_verify_looks_for_missing_ends_first(spark, monkeypatch):
    """Edges with a null or a missing end count once, repeated ones too; where no end is missing the edges aren't joined with the nodes again."""
    from arcloom.operators import sized

    nodes = spark.createDataFrame([(1,), (2,), (2,), (3,)], "id bigint")
    good = [(1, 1, 2), (2, 2, 3), (2, 3, 3)]
    graph_of = lambda rows: Graph(spark, {"N": nodes}, {"e": spark.createDataFrame(rows, "id bigint, src bigint, dst bigint")})
    found = adjacency.verify(graph_of(good))
    assert "LeftAnti" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.check_name: r.violations for r in found.collect()} == {"repeated node ids": 1, "repeated edge ids": 1, "dangling edges": 0}
    for few in (0, 10):
        monkeypatch.setattr(sized, "FEW", few)
        bad = graph_of([*good, (4, 1, 9), (4, 1, 9), (5, 8, 9), (6, None, 1), (7, 2, None), (8, None, 9)])
        assert sorted(r.id for r in adjacency.dangling_edges(bad).collect()) == [4, 5, 6, 7, 8] and adjacency.verify(bad).collect()[2].violations == 5
