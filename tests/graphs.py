"""Small graphs of the tests."""

from arcloom.model import Graph


def graph(spark, nodes, edges):
    """nodes: names or (name, properties) or (name, labels, properties), ids from 1; edges: (source, target, label[, properties])."""
    full, ids = [], {}
    for i, n in enumerate(nodes, 1):
        name, *rest = (n,) if isinstance(n, str) else n
        labels, props = rest if len(rest) == 2 else ((), rest[0] if rest else {})
        ids[name] = i
        full.append((i, labels, {"name": name, **props}))
    rels = [(i, ids[a], ids[b], label, rest[0] if rest else {}) for i, (a, b, label, *rest) in enumerate(edges, 1)]
    return Graph.of_rows(spark, full, rels)


def harbours(spark):
    """Six harbours with their depths, lines that sail one way, and trade."""
    depths = {"Aro": 11.5, "Brel": 7.0, "Cass": 19.0, "Dunn": 14.0, "Egg": 9.5, "Firth": 23.0}
    sails = [("Aro", "Brel"), ("Brel", "Cass"), ("Cass", "Dunn"), ("Dunn", "Egg"), ("Aro", "Dunn")]
    return graph(spark, [(n, {"depth": d}) for n, d in depths.items()], [*((a, b, "SAILS") for a, b in sails), ("Aro", "Cass", "TRADES"), ("Firth", "Aro", "TRADES")])


def values(df, column=0):
    return [r[column] for r in df.collect()]
