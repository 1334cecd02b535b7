import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spindle import schema
from spindle.graph import Graph
from spindle.operators import graph_ops as ops
from spindle.operators import search
from spindle.plans import pattern

NOW = datetime(2024, 6, 1)


def graph(spark, entities, observations=(), relations=()):
    rows = [(e[0], e[1], e[2], e[3], NOW, e[4] if len(e) > 4 else NOW, e[5] if len(e) > 5 else None, "") for e in entities]
    said = [(o[0], o[1], o[2], o[3] if len(o) > 3 else NOW, None, o[4] if len(o) > 4 else True) for o in observations]
    return Graph(spark.createDataFrame(rows, schema.ENTITY), spark.createDataFrame(said, schema.OBSERVATION), spark.createDataFrame([(*r, i) for i, r in enumerate(relations)], schema.RELATION))


@pytest.fixture(scope="module")
def g(spark):
    return graph(
        spark,
        [("a", "user_authentication.go", "file", "p"), ("b", "user_profile.go", "file", "p"), ("c", "database_connection.go", "file", "p"), ("d", "user_other", "file", "q"), ("f", "100%_sure", "file", "p")],
        [("o1", "a", "Handles user login authentication"), ("o2", "c", "Manages profiles"), ("o3", "c", "cut off user", NOW, False), *((f"n{i}", "b", f"note {i}", NOW - timedelta(days=i)) for i in range(5))],
        [("a", "b", "CALLS"), ("a", "b", "CALLS"), ("b", "c", "IMPORTS"), ("a", "d", "CALLS"), ("d", "a", "TESTS")],
    )


def ids(df):
    return [r["id"] for r in df.collect()]


def test_keywords(g):
    assert ids(search.keyword_hits(g, "p", "USER", 10)) == ["a", "b"]
    assert ids(search.keyword_hits(g, "p", "manages login", 10)) == ["a", "c"]
    assert ids(search.keyword_hits(g, "p", "%_", 10)) == ["f"] and ids(search.keyword_hits(g, "p", "user", 1)) == ["a"]
    for bad in ("", "  "):
        with pytest.raises(ValueError):
            search.keyword_hits(g, "p", bad, 5)


def test_newest_observations(g):
    rows = search.top_observations(g, g.entity).collect()
    by = {r["entity_id"]: [o["content"] for o in r["observations"]] for r in rows}
    assert by["b"] == ["note 0", "note 1", "note 2"] and by["c"] == ["Manages profiles"]


def test_vectors(spark):
    g = graph(spark, [("x", "x", "t", "p", NOW, [1.0, 0.0]), ("y", "y", "t", "p", NOW, [0.0, 2.0]), ("z", "z", "t", "p", NOW, [0.0, 0.0]), ("s", "s", "t", "p", NOW, [3.0]), ("n", "n", "t", "p")])
    got = {r["id"]: r["score"] for r in search.vector_hits(g, "p", [2.0, 0.0], 9).collect()}
    assert got == {"x": 1.0, "y": 0.0, "z": 0.0, "s": 1.0}


def test_recency(spark):
    df = spark.createDataFrame([(NOW - timedelta(days=1),), (NOW - timedelta(days=90),), (None,), (NOW + timedelta(days=5),)], "t timestamp")
    a, b, c, d = [r[0] for r in df.select(search.recency(F.col("t"), NOW)).collect()]
    assert 0.95 < a < 1 and 0 < b < 0.1 and c == 0 and d == 1


def test_hybrid(g):
    c = search.SearchConfig(recency_weight=0.0, limit=5)
    rows = search.hybrid_search(g, "p", "user", None, c, NOW).collect()
    assert [(r["id"], r["score"], r["match_type"]) for r in rows] == [("a", 1.0, "hybrid"), ("b", 1.0, "hybrid")]
    assert search.SearchConfig(limit=0).resolved() == search.SearchConfig()
    with pytest.raises(ValueError):
        search.SearchConfig(limit=-1).resolved()
    with pytest.raises(ValueError):
        search.hybrid_search(g, "p", "", None, c, NOW)


def test_merge_equals_the_sequential_fold(spark):
    r = random.Random(6)
    for _ in range(4):
        layers = [(i, r.randint(0, 3), [(f"e{k}", round(r.random(), 3), f"L{i}") for k in r.sample(range(8), r.randint(1, 6))]) for i in range(5)]
        best = {}
        for _, priority, hits in layers:
            for eid, score, name in hits:
                old = best.get(eid)
                if old is None or priority > old[0]:
                    best[eid] = (priority, score, name)
                elif priority == old[0]:
                    best[eid] = (priority, old[1] + score, old[2])
        got = search.merge_layers([(i, p, spark.createDataFrame(h, "id string, score double, name string")) for i, p, h in layers], None).collect()
        assert {x["id"]: (round(x["score"], 6), x["name"]) for x in got} == {k: (round(v[1], 6), v[2]) for k, v in best.items()}
        assert [x["score"] for x in got] == sorted((x["score"] for x in got), reverse=True)


def test_layers(g):
    bad = Graph(g.entity.select("id"), g.observation, g.relation)
    c = search.SearchConfig(limit=5)
    layers = [search.Layer("bad", bad, 1), search.Layer("good", g, 11)]
    assert ids(search.federated_search(layers, "p", "user", None, c, NOW)) == ["a", "b"]
    assert ids(search.federated_search([search.Layer("l", g, 1, "q")], "p", "user", None, c, NOW)) == ["d"]
    with pytest.raises(ValueError):
        search.federated_search([layers[1], layers[1]], "p", "user", None, c, NOW)
    assert [(x.name, x.priority) for x in search.scope_layers(g, [("t", g)], g)] == [("personal", 0), ("t", 1), ("primary", 11)]


def test_graph_reads(g):
    assert {r["what"]: r["n"] for r in ops.stats(g, "p").collect()} == {"entities": 4, "relations": 3, "observations": 7}
    assert ids(ops.traverse(g, "a", "CALLS", "p").orderBy("id")) == ["b", "b", "d"]
    assert [tuple(r) for r in ops.edge_groups(g, 1).collect()] == [("a", "b", "CALLS", 2)]
    assert ids(ops.orphans(g)) == ["f"] and ops.get_relations(g, "d", "p").count() == 0
    with pytest.raises(LookupError):
        ops.one(ops.get_entity(g, "a", "q"), "a")


def test_call_resolution(spark):
    f = spark.createDataFrame([("function:x:f", "f", "x"), ("function:y:f", "f", "y"), ("function:y:g", "g", "y")], "id string, name string, rel_path string")
    c = spark.createDataFrame([("k", "f", "x"), ("k", "f", "z"), ("k", "g", "x"), ("k", "h", "x")], "from_id string, callee_name string, rel_path string")
    got = {(r["callee_name"], r["rel_path"]): (r["to_id"], r["outcome"]) for r in ops.resolve_calls(f, c).collect()}
    assert got == {("f", "x"): ("function:x:f", "resolved"), ("f", "z"): (None, "ambiguous"), ("g", "x"): ("function:y:g", "resolved"), ("h", "x"): (None, "unresolved")}


ALLOWED = ["MATCH (n) RETURN n", "MATCH (a)-[:CALLS]->(b) RETURN a.id", "MATCH (n) WHERE n.name = 'reset_all' RETURN n", "MATCH (dataset) RETURN dataset.id"]
REJECTED = ["CREATE (n)", "match (n) delete n", "MATCH (n) SET n.x = 1", "MERGE (n)", "MATCH (n) DETACH DELETE n", "DROP TABLE x", "CALL x()", "LOAD FROM x", "FOREACH (x)", "MATCH (n) REMOVE n.x", "MATCH (n) WHERE n.name = 'please set it' RETURN n", "éSET x"]


def test_guard():
    for q in ALLOWED:
        pattern.guard(q)
    for q in REJECTED:
        with pytest.raises(pattern.QueryError):
            pattern.guard(q)


def test_patterns(g):
    run = lambda q, **p: sorted(map(tuple, pattern.query(g, q, p).collect()))
    assert run("MATCH (a)-[:CALLS|IMPORTS]->(b) RETURN DISTINCT a.id, b.id") == [("a", "b"), ("a", "d"), ("b", "c")]
    assert run("MATCH (a {id: 'a'})-[:CALLS*1..2]-(x) RETURN DISTINCT x.id") == [("a",), ("b",), ("d",)]
    assert run("MATCH (a)<-[r]-(b) WHERE a.id = $x RETURN b.id, label(r)", x="a") == [("d", "TESTS")]
    assert run("MATCH (a) OPTIONAL MATCH (a)-[:IMPORTS]->(b) WHERE b.id <> 'zz' RETURN a.id, count(b)") == [("a", 0), ("b", 1), ("c", 0), ("d", 0), ("f", 0)]
    assert run("MATCH (e)-[:HAS_OBSERVATION]->(o) WHERE o.content CONTAINS 'user' RETURN e.id, o.id") == [("a", "o1")]
    assert run("MATCH (e:file) WHERE NOT (e)-[:CALLS]->() AND e.project_id = 'p' RETURN e.id") == [("b",), ("c",), ("f",)]
    assert run("MATCH (e) WHERE (e.id = 'f' OR NOT EXISTS { MATCH (e)<-[]-(x) }) RETURN e.id") == [("f",)]
    assert run("UNWIND [1, 2] AS x WITH x WHERE x > 1 RETURN x + 1 AS y") == [(3,)]
    assert run("MATCH (n) WITH n.project_id AS p, count(*) AS k WHERE k > 1 RETURN p, k") == [("p", 4)]
    assert [r["n"]["id"] for r in pattern.query(g, "MATCH (n) WHERE n.id IN ['a'] RETURN n").collect()] == ["a"]
    assert run("MATCH (a), (b) WHERE a.id = 'a' AND b.id = 'c' RETURN a.id, b.id") == [("a", "c")]
    for bad in ("MATCH (n)", "RETURN", "MATCH (n RETURN n", "MATCH (n) RETURN m.id", "MATCH (n) RETURN n.nothing", "MATCH (a)-[*1..99]->(b) RETURN a", "MATCH (n) RETURN n.id ~"):
        with pytest.raises(pattern.QueryError):
            pattern.query(g, bad)
