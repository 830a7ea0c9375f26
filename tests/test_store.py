import pytest
from graphs import values

from arcloom.engine import Engine, QueryTimeout, ResultTooLarge
from arcloom.operators import adjacency
from arcloom.operators.constraints import UniqueViolation
from arcloom.plans.ast import CypherError
from arcloom.store import ConflictError, ReadOnlyError, Store
from arcloom.streaming.replay import follow, replay


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def test_nodes_and_edges(store):
    a, b = store.add_node({"name": "A", "age": 30.0}), store.add_node({"name": "B"}, ["Person"])
    e = store.add_edge(a, b, "KNOWS", {"since": 2020})
    assert (a, b, e) == (1, 2, 1) and store.graph().node(1).first().name == "A"
    store.update_node(a, {"age": 31.0, "city": "X"})
    assert store.graph().node(a).first().asDict()["age"] == 31.0 and store.graph().node(a).first().name == "A"
    store.set_node_props(a, {"name": "A2"})
    r = store.graph().node(a).first()
    assert (r.name, r.age) == ("A2", None)
    store.update_edge(e, {"weight": 1.0})
    assert store.graph().edge(e).first().since == 2020
    store.add_label(a, "Person", "Admin")
    store.remove_label(a, "Person")
    assert store.graph().node(a).first().labels == ["Admin"] and store.graph().find_by_label("Person").count() == 1
    store.delete_edge(e)
    assert store.graph().edge_count() == 0
    for bad in (lambda: store.add_edge(a, 99, "X"), lambda: store.update_node(99, {}), lambda: store.delete_node(99), lambda: store.delete_edge(99)):
        with pytest.raises(KeyError):
            bad()


def test_cascade(store):
    a, b, c = store.add_nodes([{"n": i} for i in range(3)])
    store.add_edges([(a, b, "f", {}), (b, c, "f", {}), (c, a, "f", {})], check=True)
    store.delete_node(b)
    assert store.graph().node_count() == 2 and store.graph().edge_count() == 1


def test_bulk(spark, store):
    store.load_nodes(spark.range(1, 1001).selectExpr("id", "concat('n', id) AS name"), ["N"])
    store.load_edges(spark.range(1, 1000).selectExpr("id", "id AS src", "id + 1 AS dst"), "next", check=True)
    assert store.graph().edge_count() == 999 and adjacency.dangling_edges(store.graph()).isEmpty() and store.add_node({"name": "x"}) == 1001
    with pytest.raises(KeyError):
        store.load_edges(spark.range(5000, 5001).selectExpr("id", "id AS src", "id AS dst"), "next", check=True)


def test_unique(store):
    store.add_node({"email": "a"}, ["P"])
    store.add_node({"email": "a"}, ["Q"])
    store.create_unique("P", "email")
    store.create_unique("P", "email")
    assert store.unique_constraints() == [("P", "email")]
    with pytest.raises(UniqueViolation):
        store.add_node({"email": "a"}, ["P"])
    with pytest.raises(UniqueViolation):
        store.create_unique("P", "email") if False else store.add_label(2, "P")
    store.add_node({"other": 1}, ["P"])
    store.add_node({"other": 1}, ["P"])
    # D-16, D-23: a value is free when no node of the label has it
    store.update_node(1, {"email": "b"})
    n = store.add_node({"email": "a"}, ["P"])
    store.remove_label(n, "P")
    store.add_node({"email": "a"}, ["P"])
    store.drop_unique("P", "email")
    assert not store.has_unique("P", "email")


def test_existing_duplicates(store):
    store.add_nodes([{"email": "d"}, {"email": "d"}], ["P"])
    with pytest.raises(UniqueViolation):
        store.create_unique("P", "email")
    assert store.unique_constraints() == []


def test_d11_indexes_change_nothing(store):
    store.add_nodes([{"name": n, "coast": c} for n, c in (("Aro", "west"), ("Brel", "east"), ("Cass", "west"), ("Dunn", "north"))])
    before = sorted(values(store.graph().find_by_property("coast", "west")))
    store.create_index("coast")
    store.create_index("coast", "name")
    store.reindex()
    assert sorted(values(store.graph().find_by_property("coast", "west"))) == before and len(before) == 2
    assert store.graph().find_by_properties({"coast": "west", "name": "Cass"}).count() == 1 and store.has_index("coast", "name")
    store.drop_index("coast")
    assert store.indexes() == [("coast", "name")] and store.graph().indexes == {("coast", "name")}
    with pytest.raises(ValueError):
        store.graph().find_by_properties({"coast": "x"})


def test_create(store):
    w = store.cypher('CREATE (a:Person {name: "A"})')
    assert w.rows is None and (w.stats.nodes_created, w.stats.labels_set, w.stats.props_set) == (1, 1, 1)
    w = store.cypher('CREATE (a:Person {name: "B"})-[r:KNOWS]->(b:Person {name: "C"}), (b)-[:KNOWS]->(c {name: "D"}) RETURN a.name, type(r), b')
    row = w.rows.first()
    assert (row[0], row[1], row[2].name) == ("B", "KNOWS", "C") and w.stats.nodes_created == 3 and w.stats.edges_created == 2
    assert store.cypher("MATCH (x {name: 'B'})-[:KNOWS*2]->(y) RETURN y.name").first()[0] == "D"


def test_merge(store):
    q = 'MERGE (n:Person {name: "A"}) ON CREATE SET n.source = "new" ON MATCH SET n.source = "existing" RETURN n.source, id(n)'
    assert [tuple(store.cypher(q).rows.first()) for _ in range(2)] == [("new", 1), ("existing", 1)] and store.graph().node_count() == 1


def test_d6_set_and_delete_reach_every_match(store):
    store.cypher("CREATE (a:P {v: 1})-[:E]->(b:P {v: 2}), (c:P {v: 3})")
    w = store.cypher('MATCH (n:P) WHERE n.v > 1 SET n.city = "X", n.v = 30 RETURN n.city LIMIT 1')
    assert w.rows.count() == 1 and sorted(values(store.cypher("MATCH (n:P) RETURN n.v"))) == [1, 30, 30]
    store.cypher("MATCH (a)-[r:E]->(b) SET r.w = 5 RETURN type(r)")
    assert store.graph().edges("E").first().w == 5
    w = store.cypher("MATCH (a)-[r:E]->(b) DELETE r, b RETURN id(b)")
    assert (w.stats.nodes_deleted, w.stats.edges_deleted) == (1, 1) and store.graph().node_count() == 2 and store.graph().edge_count() == 0


def test_d14_d15_parameters_write_too(store):
    store.cypher("MERGE (n:P {k: $k})", {"k": 7})
    store.cypher("MATCH (n:P {k: $k}) SET n.seen = $s RETURN n", {"k": 7, "s": True})
    assert store.graph().nodes().first().seen is True
    with pytest.raises(CypherError):
        store.snapshot().cypher("MERGE (n:P {k: 1})")


def test_d7_snapshot(store):
    store.add_node({"n": 1})
    snap = store.snapshot()
    store.add_node({"n": 2})
    assert snap.cypher("MATCH (n) RETURN n").count() == 1 and store.cypher("MATCH (n) RETURN n").count() == 2


def test_d18_transactions(store):
    store.create_unique("P", "k")
    tx = store.begin()
    a = tx.add_node({"k": 1}, ["P"])
    tx.update_node(a, {"v": 2})
    assert tx.get_node(a)["v"] == 2 and store.graph().node_count() == 0
    with pytest.raises(KeyError):
        tx.add_edge(a, 99, "X")
    tx.rollback()
    assert store.graph().node_count() == 0
    tx = store.begin()
    tx.add_nodes([{"k": 1}, {"k": 1}], ["P"])
    with pytest.raises(UniqueViolation):
        tx.commit()
    assert store.graph().node_count() == 0
    one, two = store.begin(), store.begin()
    one.add_node({"k": 1}, ["P"])
    two.add_node({"k": 2}, ["P"])
    one.commit()
    with pytest.raises(ConflictError):
        two.commit()
    assert store.graph().node_count() == 1


def test_log_replay(spark, store, tmp_path):
    a = store.add_node({"name": "Wren", "tons": 40})
    b = store.add_node({"name": "Heron"}, ["Ship"])
    c, _ = store.add_nodes([{"name": "Teal"}, {"name": "Crane"}])
    store.update_node(a, {"tons": 44, "flag": "blue"})
    store.set_node_props(a, {"name": "Wren II", "tons": 45.5})
    store.add_label(b, "Tug")
    store.remove_label(b, "Tug")
    e = store.add_edge(a, b, "TOWS")
    store.add_edges([(b, c, "PASSES", {"knots": 9})])
    store.update_edge(e, {"miles": 2.5})
    store.delete_edge(e)
    store.cypher("MATCH (n {name: 'Teal'}) SET n.tons = 7 RETURN n")
    store.create_index("name")
    store.drop_index("name")
    other = Store(spark, f"file://{tmp_path}/other")
    follow(store, other, f"{tmp_path}/checkpoint", once=True).awaitTermination()
    rows = lambda df: sorted(str(r) for r in df.collect())
    assert rows(other.graph().nodes()) == rows(store.graph().nodes()) and rows(other.graph().edges()) == rows(store.graph().edges())
    assert other.graph().node_count() == 4 and other.graph().edge_count() == 1 and replay(store.changes(), other) == 0
    store.delete_node(b)
    assert replay(store.changes(), other, at_once=1) == 1 and other.graph().node_count() == 3 and other.graph().edge_count() == 0
    with pytest.raises(ReadOnlyError):
        Store(spark, other.path, read_only=True).add_node({})
    last = store.state().lsn
    assert store.trim(last) > 10
    assert store.changes().count() == 0 and store.add_node({}) and [r.lsn for r in store.changes(last).collect()] == [last + 1]


def test_a_commit_that_loses_leaves_no_record(spark, store, tmp_path):
    one, two = store.begin(), store.begin()
    one.add_node({"name": "winner"})
    two.add_node({"name": "loser"})
    one.commit()
    with pytest.raises(ConflictError):
        two.commit()
    store.add_node({"name": "later"})
    names = [r.payload for r in store.changes().collect()]
    assert len(names) == 2 and "winner" in names[0] and "later" in names[1] and len(store.files.names(f"{store.path}/log")) == 2
    other = Store(spark, f"file://{tmp_path}/other")
    assert replay(store.changes(), other) == 2 and sorted(values(other.graph().nodes().select("name"))) == ["later", "winner"]
    twice = store.changes().unionAll(store.changes())
    with pytest.raises(ValueError):
        replay(twice, Store(spark, f"file://{tmp_path}/third"))
    assert store.prune(10, unnamed_after=0.0) == 0 and store.graph().node_count() == 2


def test_writes_add_small_parts(spark, store):
    store.load_nodes(spark.range(1, 2001).selectExpr("id", "id % 10 AS kind", "concat('n', id) AS name"), ["N"])
    before = store.state().nodes["N"]
    store.add_node({"kind": 3, "name": "x"}, ["N"])
    store.update_node(5, {"kind": 77})
    store.delete_node(6)
    after = store.state().nodes["N"]
    assert after[: len(before)] == before and [k for k, _ in after[len(before) :]] == ["+", "-", "+", "-"]
    assert max(spark.read.parquet(p).count() for _, p in after[len(before) :]) == 1
    nodes = store.graph().find_by_label("N")
    assert nodes.count() == 2000 and nodes.where("id = 5").first().kind == 77 and nodes.where("id = 6").isEmpty() and nodes.where("id = 5").first().name == "n5"
    for i in range(30):
        store.update_node(7, {"kind": i})
    assert len(store.state().nodes["N"]) <= 25 and store.graph().node(7).first().kind == 29


def test_checksums_find_a_changed_row(store):
    store.load_nodes(store.spark.range(1, 101).selectExpr("id", "concat('n', id) AS name"), ["N"])
    store.add_edge(1, 2, "E")
    rows = lambda: {(r.kind, r.label): (r.n, r.checksum) for r in adjacency.checksums(store.graph()).collect()}
    before = rows()
    store.compact(3)
    assert rows() == before and before["node", "N"][0] == 100
    store.update_node(7, {"name": "other"})
    after = rows()
    assert after["edge", "E"] == before["edge", "E"] and after["node", "N"][0] == 100 and after["node", "N"] != before["node", "N"]


def test_compact_and_prune(store):
    for i in range(3):
        store.add_node({"n": i}, ["P"])
    store.compact(1)
    assert store.prune(1) == 4 and sorted(values(store.cypher("MATCH (n) RETURN n.n"))) == [0, 1, 2]


def test_d21_engine(store):
    store.add_nodes([{"i": i, "name": f"n{i}"} for i in range(10)], ["P"])
    e = Engine(store, max_rows=5, slow=0)
    with pytest.raises(ResultTooLarge):
        e.run("MATCH (n:P) RETURN n")
    assert len(e.run("MATCH (n) RETURN n.i ORDER BY n.i LIMIT 3")) == 3
    name = e.prepare("MATCH (n {i: $i}) RETURN n.name")
    assert len(name) == 16 and e.execute(name, {"i": 3})[0][0] == "n3" and e.execute(name, {"i": 4})[0][0] == "n4"
    out = e.json("MATCH (n {i: 1}) RETURN n, n.name")
    assert out["columns"] == ["n", "n.name"] and out["rowCount"] == 1 and out["graph"]["nodes"][0]["label"] == "n1"
    assert len(list(e.ndjson("MATCH (n) RETURN n.i"))) == 10 and "error" in list(e.ndjson("MATCH (n) RETURN m"))[-1]
    assert "arcloom_queries_total" in e.prometheus() and len(e.slow_queries) == 5 and e.cache_stats()["entries"] > 0
    with pytest.raises(CypherError):
        e.run("NOT A QUERY")


def test_engine_timeout(spark, store):
    class Slow:
        def __init__(self):
            self.spark = spark

        def cypher(self, text, params=None):
            return spark.sql("SELECT count(*) FROM range(100000000) a JOIN range(100000) b ON hash(a.id) % 3 = hash(b.id) % 5")

    with pytest.raises(QueryTimeout):
        Engine(Slow(), timeout=1.0).run("slow")
