"""The registered queries over the driver's tables, named by operator, with their SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import strings
from .functions.convert import converted
from .graph import Graph
from .operators import graph_ops as ops
from .operators import perf, search
from .plans import pattern, testgraph
from .plans.testgraph import WITH
from .session import spread
from .sources import files
from .streaming import log_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

NOW = datetime(2001, 8, 2)
_NOW = "TIMESTAMP '2001-08-02 00:00:00'"


def add(name: str, query: Query, sql: str | None = None, graph: bool = True) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = (WITH if graph else "") + sql


def on_graph(f: Callable[[Graph], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(testgraph.load(spark, sf_dir))


def cypher(text: str, **params) -> Query:
    return on_graph(lambda g: pattern.query(g, text, params))


# ---------------------------------------------------------------- point reads and listings

_E = "id, name, type, project_id"
add("crud2_get_entity", on_graph(lambda g: ops.get_entity(g, "customer:12", "p1").select("id", "name", "type", "project_id")), f"SELECT {_E} FROM entity WHERE id = 'customer:12' AND project_id = 'p1'")
add("crud3_get_entity_by_name", on_graph(lambda g: ops.get_entity_by_name(g, "ASIA", "p1").select("id", "name", "type", "project_id")), f"SELECT {_E} FROM entity WHERE name = 'ASIA' AND project_id = 'p1' ORDER BY id LIMIT 1")
add("crud4_list_entities", on_graph(lambda g: ops.list_entities(g, "p1", "supplier").select("id", "name", "type", "project_id")), f"SELECT {_E} FROM entity WHERE project_id = 'p1' AND type = 'supplier'")
add(
    "crud7_get_observations", on_graph(lambda g: ops.get_observations(g, "customer:6", "p1").select("id", "content")),
    "SELECT o.id, o.content FROM observation o JOIN entity e ON e.id = o.entity_id WHERE o.linked AND e.id = 'customer:6' AND e.project_id = 'p1'",
)
add(
    "crud10_get_relations", on_graph(lambda g: ops.get_relations(g, "nation:4", "p1")),
    "SELECT r.from_id, r.to_id, r.rel_type, b.name AS to_name FROM relation r JOIN entity a ON a.id = r.from_id JOIN entity b ON b.id = r.to_id WHERE a.id = 'nation:4' AND a.project_id = 'p1'",
)
add(
    "crud12_traverse", on_graph(lambda g: ops.traverse(g, "order:2", "CONTAINS", "p1")),
    "SELECT b.id, b.name, b.type, b.project_id FROM relation r JOIN entity a ON a.id = r.from_id JOIN entity b ON b.id = r.to_id WHERE a.id = 'order:2' AND a.project_id = 'p1' AND r.rel_type = 'CONTAINS'",
)
add("src16_relation_types", on_graph(ops.relation_tables), "SELECT DISTINCT rel_type FROM relation")

# ---------------------------------------------------------------- aggregates

_IN = "(SELECT id FROM entity WHERE project_id = 'p1')"
_A2 = f"SELECT count(*) FROM relation WHERE from_id IN {_IN} AND to_id IN {_IN}"
_A3 = f"SELECT count(*) FROM observation WHERE linked AND entity_id IN {_IN}"
add("a1_count_entities", on_graph(lambda g: ops.count_entities(g, "p1")), "SELECT count(*) AS n FROM entity WHERE project_id = 'p1'")
add("a2_count_relations", on_graph(lambda g: ops.count_relations(g, "p1")), f"SELECT ({_A2}) AS n")
add("a3_count_observations", on_graph(lambda g: ops.count_observations(g, "p1")), f"SELECT ({_A3}) AS n")
add("a4_stats", on_graph(lambda g: ops.stats(g, "p1")), f"SELECT 'entities' AS what, count(*) AS n FROM entity WHERE project_id = 'p1' UNION ALL SELECT 'relations', ({_A2}) UNION ALL SELECT 'observations', ({_A3})")
add("a5_count_by_type", on_graph(ops.entities_by_type), "SELECT type, count(*) AS n FROM entity GROUP BY type")
add("a6_edge_groups", on_graph(ops.edge_groups), "SELECT from_id, to_id, rel_type, count(*) AS n FROM relation GROUP BY ALL")
add("a7_duplicate_edges", on_graph(lambda g: ops.edge_groups(g, 1)), "SELECT from_id, to_id, rel_type, count(*) AS n FROM relation GROUP BY ALL HAVING count(*) > 1")

# ---------------------------------------------------------------- joins

_HOP = "SELECT r.from_id, r.to_id, r.rel_type, a.name AS from_name, b.name AS to_name FROM relation r JOIN entity a ON a.id = r.from_id JOIN entity b ON b.id = r.to_id"
add("j1_typed_hop", on_graph(lambda g: ops.hop(g, "BELONGS_TO", "customer", "nation")), f"{_HOP} WHERE r.rel_type = 'BELONGS_TO' AND a.type = 'customer' AND b.type = 'nation'")
add("j2_any_hop", on_graph(lambda g: ops.hop(g, None, "nation", None)), f"{_HOP} WHERE a.type = 'nation'")
add("j3_entity_observations", on_graph(ops.with_observations), "SELECT e.id AS entity_id, e.name, e.type, e.project_id, o.id AS obs_id, o.content FROM entity e JOIN observation o ON o.entity_id = e.id WHERE o.linked")
add("j4_pair_by_ids", cypher("MATCH (a:Entity), (b:Entity) WHERE a.id = $x AND b.id = $y RETURN a.id AS from_id, b.id AS to_id", x="customer:1", y="nation:3"), "SELECT a.id AS from_id, b.id AS to_id FROM entity a, entity b WHERE a.id = 'customer:1' AND b.id = 'nation:3'")
add("j5_semi_join", cypher("MATCH (n:Entity) WHERE EXISTS { MATCH (n)-[:HAS_OBSERVATION]->(x:Observation) WHERE x.content CONTAINS 'purchase' } RETURN n.id AS id"), "SELECT id FROM entity e WHERE EXISTS (SELECT 1 FROM observation o WHERE o.linked AND o.entity_id = e.id AND contains(o.content, 'purchase'))")
add("j6_orphans", on_graph(lambda g: ops.orphans(g).select("id", "type")), "SELECT id, type FROM entity e WHERE NOT EXISTS (SELECT 1 FROM relation r WHERE r.to_id = e.id)")
add(
    "j8_load_relations", on_graph(lambda g: ops.load_relations(g.entity.where("project_id = 'p1'"), g.relation)),
    f"SELECT DISTINCT from_id, to_id, rel_type FROM relation WHERE from_id IN {_IN} AND to_id IN {_IN}",
)
add(
    "j10_optional_match", cypher("MATCH (n:nation) OPTIONAL MATCH (n)<-[:BELONGS_TO]-(s:supplier) RETURN n.id AS id, count(s) AS n"),
    "SELECT e.id, count(s.id) AS n FROM entity e LEFT JOIN (relation r JOIN entity s ON s.id = r.from_id AND s.type = 'supplier' AND r.rel_type = 'BELONGS_TO') ON r.to_id = e.id WHERE e.type = 'nation' GROUP BY e.id",
)
add(
    "j11_two_hops", cypher("MATCH (c:customer)-[:BELONGS_TO]->(n:nation)-[:BELONGS_TO]->(r:region) RETURN r.name AS region, n.name AS nation, count(c) AS customers"),
    "SELECT z.name AS region, n.name AS nation, count(*) AS customers FROM entity c JOIN relation a ON a.from_id = c.id AND a.rel_type = 'BELONGS_TO' JOIN entity n ON n.id = a.to_id AND n.type = 'nation' "
    "JOIN relation b ON b.from_id = n.id AND b.rel_type = 'BELONGS_TO' JOIN entity z ON z.id = b.to_id AND z.type = 'region' WHERE c.type = 'customer' GROUP BY ALL",
)

#: Calls made from the tables: orders call parts by name, some names being shared, some unknown.
_FUNCS = "SELECT concat('function:', p_brand, ':', p_name) AS id, p_name AS name, p_brand AS rel_path FROM part"
_CALLS = (
    "SELECT concat('function:', p_brand, ':caller') AS from_id, CASE WHEN l_linenumber = 7 THEN 'unknown' ELSE p_name END AS callee_name, "
    "CASE WHEN l_linenumber % 2 = 0 THEN p_brand ELSE 'other' END AS rel_path FROM lineitem JOIN part ON p_partkey = l_partkey"
)


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "lineitem")}
    functions = spark.sql(_FUNCS.replace("FROM part", "FROM {part}"), part=frames["part"])
    calls = spark.sql(_CALLS.replace("FROM lineitem JOIN part", "FROM {lineitem} JOIN {part}"), **frames)
    return ops.resolve_calls(functions, calls)


_RESOLVED = f"""WITH f AS ({_FUNCS}), c AS ({_CALLS}), own AS (SELECT DISTINCT id FROM f),
n AS (SELECT name, count(DISTINCT id) AS k, min(id) AS only_id FROM f GROUP BY name),
resolved AS (
  SELECT from_id, callee_name, rel_path, CASE WHEN own.id IS NOT NULL THEN own.id WHEN k = 1 THEN only_id END AS to_id,
    CASE WHEN own.id IS NOT NULL OR k = 1 THEN 'resolved' WHEN k > 1 THEN 'ambiguous' ELSE 'unresolved' END AS outcome
  FROM c LEFT JOIN own ON own.id = concat('function:', rel_path, ':', callee_name) LEFT JOIN n ON n.name = callee_name
) """
add("j7_resolve_calls", _calls, _RESOLVED + "SELECT * FROM resolved", graph=False)
add(
    "a12_call_counts", lambda spark, sf_dir: ops.call_counts(_calls(spark, sf_dir)),
    _RESOLVED + "SELECT count(*) AS calls, " + ", ".join(f"CAST(sum(CASE WHEN outcome = '{o}' THEN 1 ELSE 0 END) AS BIGINT) AS {o}" for o in ("resolved", "ambiguous", "unresolved")) + " FROM resolved",
    graph=False,
)

# ---------------------------------------------------------------- predicates and the pattern language

add("p1_inline_map", cypher("MATCH (e:Entity {type: 'nation', project_id: $p}) RETURN e.id AS id, e.name AS name", p="p2"), "SELECT id, name FROM entity WHERE type = 'nation' AND project_id = 'p2'")
add("p2_in_list", cypher("MATCH (e:Entity) WHERE e.id IN $ids RETURN e.id AS id, e.type AS type", ids=["nation:1", "part:7", "none"]), "SELECT id, type FROM entity WHERE id IN ('nation:1', 'part:7', 'none')")
add("p3_is_null", cypher("MATCH (e:Entity) WHERE e.updated_at IS NOT NULL AND e.name IS NOT NULL RETURN count(*) AS n"), "SELECT count(*) AS n FROM entity WHERE updated_at IS NOT NULL AND name IS NOT NULL")
add("p4_contains", cypher("MATCH (e:Entity) WHERE e.name CONTAINS '000' RETURN e.id AS id"), "SELECT id FROM entity WHERE contains(name, '000')")
add("p5_starts_with", cypher("MATCH (e:Entity) WHERE e.id STARTS WITH 'customer:1' RETURN e.id AS id"), "SELECT id FROM entity WHERE starts_with(id, 'customer:1')")
add("p6_lower", cypher("MATCH (e:Entity) WHERE lower(e.name) CONTAINS 'urgent' RETURN count(*) AS n"), "SELECT count(*) AS n FROM entity WHERE contains(lower(name), 'urgent')")
add("p7_and_or_not", cypher("MATCH (e:Entity) WHERE (e.type = 'nation' OR e.type = 'region') AND NOT e.project_id = 'p1' RETURN e.id AS id"), "SELECT id FROM entity WHERE type IN ('nation', 'region') AND NOT project_id = 'p1'")
add(
    "p8_exists_under_or",
    cypher("MATCH (n:Entity) WHERE n.name CONTAINS '00001' OR EXISTS { MATCH (n)-[:HAS_OBSERVATION]->(x:Observation) WHERE lower(x.content) CONTAINS 'signup' } RETURN n.id AS id"),
    "SELECT id FROM entity e WHERE contains(name, '00001') OR EXISTS (SELECT 1 FROM observation o WHERE o.linked AND o.entity_id = e.id AND contains(lower(o.content), 'signup'))",
)
add("p9_not_pattern", cypher("MATCH (e:Entity) WHERE e.type = 'supplier' AND NOT ()-[:DEPENDS_ON]->(e) RETURN e.id AS id"), "SELECT id FROM entity e WHERE type = 'supplier' AND NOT EXISTS (SELECT 1 FROM relation r WHERE r.rel_type = 'DEPENDS_ON' AND r.to_id = e.id)")
add(
    "p10_aggregate_filter", cypher("MATCH (a:Entity)-[r:CONTAINS]->(b:Entity) WITH a.id AS source, b.id AS target, count(*) AS n WHERE n > 1 RETURN source, target, n"),
    "SELECT from_id AS source, to_id AS target, count(*) AS n FROM relation WHERE rel_type = 'CONTAINS' GROUP BY ALL HAVING count(*) > 1",
)
add("p12_distinct_alias", cypher("MATCH (e:Entity) RETURN DISTINCT e.type AS kind, e.project_id AS project"), "SELECT DISTINCT type AS kind, project_id AS project FROM entity")
add("p13_type_alternation", cypher("MATCH (a:Entity)-[r:BELONGS_TO|DEPENDS_ON]->(b:Entity) RETURN label(r) AS kind, count(r) AS n"), "SELECT rel_type AS kind, count(*) AS n FROM relation WHERE rel_type IN ('BELONGS_TO', 'DEPENDS_ON') GROUP BY rel_type")
add("p13_untyped_edges", cypher("MATCH (a:customer)-[r]->(b) RETURN label(r) AS kind, b.type AS target, count(*) AS n"), "SELECT r.rel_type AS kind, b.type AS target, count(*) AS n FROM relation r JOIN entity a ON a.id = r.from_id AND a.type = 'customer' JOIN entity b ON b.id = r.to_id GROUP BY ALL")
add("p14_incoming_edges", cypher("MATCH (r:region)<-[:BELONGS_TO]-(n:nation) RETURN r.name AS region, n.name AS nation"), f"SELECT to_name AS region, from_name AS nation FROM ({_HOP} WHERE r.rel_type = 'BELONGS_TO' AND a.type = 'nation' AND b.type = 'region')")
add(
    "p15_variable_length", cypher("MATCH (c:customer {id: 'customer:5'})-[:BELONGS_TO*1..2]->(x) RETURN x.id AS id"),
    "SELECT b.id FROM relation r JOIN entity b ON b.id = r.to_id WHERE r.from_id = 'customer:5' AND r.rel_type = 'BELONGS_TO' UNION ALL "
    "SELECT b.id FROM relation r JOIN relation q ON q.from_id = r.to_id JOIN entity b ON b.id = q.to_id WHERE r.from_id = 'customer:5' AND r.rel_type = 'BELONGS_TO' AND q.rel_type = 'BELONGS_TO'",
)
add("s4_unwind", cypher("UNWIND ['nation:1', 'nation:2'] AS x MATCH (e:Entity) WHERE e.id = x RETURN x, e.name AS name"), "SELECT id AS x, name FROM entity WHERE id IN ('nation:1', 'nation:2')")

# ---------------------------------------------------------------- sorts, limits and sets

add("w2_order_limit", cypher("MATCH (e:Entity) WHERE e.type = 'order' RETURN e.id AS id ORDER BY e.updated_at DESC, e.id LIMIT 25"), "SELECT id FROM entity WHERE type = 'order' ORDER BY updated_at DESC, id LIMIT 25")
add("w3_two_keys", cypher("MATCH (e:part) RETURN e.name AS name, e.id AS id ORDER BY e.name, e.id DESC LIMIT 40"), "SELECT name, id FROM entity WHERE type = 'part' ORDER BY name, id DESC LIMIT 40")
add("w4_skip_limit", cypher("MATCH (e:nation) RETURN e.id AS id ORDER BY e.name SKIP 5 LIMIT 7"), "SELECT id FROM entity WHERE type = 'nation' ORDER BY name OFFSET 5 LIMIT 7")
_FIRST = "SELECT p_name AS id, p_brand AS rel_path, CAST(p_partkey AS INTEGER) AS ordinal, p_type AS kind FROM part"
add(
    "w6_first_seen", lambda spark, sf_dir: ops.first_seen(spark.sql(_FIRST.replace("FROM part", "FROM {part}"), part=spark.read.parquet(f"{sf_dir}/part.parquet"))),
    f"SELECT id, rel_path, ordinal, kind FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rel_path, ordinal) AS k FROM ({_FIRST})) WHERE k = 1", graph=False,
)

# ---------------------------------------------------------------- ranked search


def keyword_sql(words: list[str], project: str, limit: int) -> str:
    name = " OR ".join(f"contains(lower(name), '{w}')" for w in words)
    said = " OR ".join(f"contains(lower(o.content), '{w}')" for w in words)
    return (
        f"SELECT id, name, type, project_id, updated_at, 1.0::DOUBLE AS score FROM entity e WHERE project_id = '{project}' AND ({name} OR EXISTS "
        f"(SELECT 1 FROM observation o WHERE o.linked AND o.entity_id = e.id AND ({said}))) ORDER BY updated_at DESC NULLS LAST, id LIMIT {limit}"
    )


_RECENCY = f"least(1.0, greatest(0.0, exp(-((epoch_us({_NOW}) - epoch_us(updated_at)) / 8.64e10) / 30)))"


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, F.round("score", 6).alias("score"))


add("r1_keyword_search", on_graph(lambda g: search.keyword_hits(g, "p1", "urgent signup", 50).select("id", "name", "type", "score")), f"SELECT id, name, type, score FROM ({keyword_sql(['urgent', 'signup'], 'p1', 50)})")
_TOP3 = "SELECT entity_id, string_agg(content, '|' ORDER BY k) AS observations FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC NULLS LAST, id) AS k FROM observation WHERE linked) WHERE k <= 3 {where} GROUP BY entity_id"


def _shown():
    return F.array_join(F.transform("observations", lambda o: o["content"]), "|").alias("observations")


add(
    "r2_top_observations", on_graph(lambda g: search.top_observations(g, g.entity.where("id = 'customer:6'")).select("entity_id", _shown())),
    _TOP3.format(where="AND entity_id = 'customer:6'"),
)
add(
    "r3_batch_observations", on_graph(lambda g: search.top_observations(g, g.entity.where("type = 'customer'")).select("entity_id", _shown())),
    _TOP3.format(where="AND entity_id IN (SELECT id FROM entity WHERE type = 'customer')"),
)


def _vector_graph(spark: SparkSession, sf_dir: str) -> Graph:
    g = testgraph.load(spark, sf_dir)
    return Graph(testgraph.vectors(spark, sf_dir), g.observation, g.relation)


_ASKED = [round(((i * 37) % 64 - 31.5) / 64, 4) for i in range(64)]
_COS = (
    "list_dot_product(CAST(embedding AS DOUBLE[]), q) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(q, q)))"
)
_VEC = f"SELECT concat('vec:', vec_id) AS id, {_COS} AS score FROM embeddings, (SELECT {_ASKED}::DOUBLE[] AS q) WHERE vec_id % 2 = 0 ORDER BY score DESC, id LIMIT 10"
add("r4_vector_search", lambda spark, sf_dir: _rounded(search.vector_hits(_vector_graph(spark, sf_dir), "p1", _ASKED, 10), "id"), f"SELECT id, round(score, 6) AS score FROM ({_VEC})", graph=False)

_HYBRID = f"SELECT id, name, type, score + 0.1 * {_RECENCY} AS score FROM ({{hits}}) ORDER BY score DESC, id LIMIT {{limit}}"
add(
    "r7_hybrid_search", on_graph(lambda g: _rounded(search.hybrid_search(g, "p1", "urgent signup", None, search.SearchConfig(), NOW), "id", "name", "type", "match_type")),
    "SELECT id, name, type, 'hybrid' AS match_type, round(score, 6) AS score FROM (" + _HYBRID.format(hits=keyword_sql(["urgent", "signup"], "p1", 40), limit=20) + ")",
)
add(
    "r7_hybrid_with_vector",
    lambda spark, sf_dir: _rounded(search.hybrid_search(_vector_graph(spark, sf_dir), "p1", "vector 3", _ASKED, search.SearchConfig(recency_weight=0.0, limit=10), NOW), "id"),
    f"""WITH v AS (SELECT concat('vec:', vec_id) AS id, concat('vector ', label) AS name, {_COS} AS c FROM embeddings, (SELECT {_ASKED}::DOUBLE[] AS q) WHERE vec_id % 2 = 0),
    k AS (SELECT id, 1.0::DOUBLE AS score FROM v WHERE contains(name, 'vector') OR contains(name, '3') ORDER BY id LIMIT 20), n AS (SELECT id, c AS score FROM v ORDER BY c DESC, id LIMIT 20)
    SELECT id, round(sum(score), 6) AS score FROM (SELECT * FROM k UNION ALL SELECT * FROM n) GROUP BY id ORDER BY sum(score) DESC, id LIMIT 10""",
    graph=False,
)
add(
    "r8_recency", on_graph(lambda g: g.entity.where("type = 'order'").select("id", F.round(search.recency(F.col("updated_at"), NOW), 6).alias("recency"))),
    f"SELECT id, round({_RECENCY}, 6) AS recency FROM entity WHERE type = 'order'",
)


def _layers(g: Graph) -> list[search.Layer]:
    """Three layers with shared ids: orders and customers, customers and nations, everything."""
    some = lambda *kinds: Graph(g.entity.where(F.col("type").isin(*kinds)), g.observation, g.relation)
    return [search.Layer("base", some("order", "customer"), 1), search.Layer("team", some("customer", "nation"), 1), search.Layer("primary", some("nation", "region"), 11)]


_LAYER = "SELECT {n} AS ordinal, {p} AS priority, id, name, type, score + {w} * {r} AS score FROM (" + keyword_sql(["signup", "a"], "p1", 60).replace("FROM entity e WHERE", "FROM entity e WHERE type IN ({kinds}) AND") + ") ORDER BY score DESC, id LIMIT 30"


def _federated_sql(weight: float) -> str:
    parts = [
        _LAYER.format(n=n, p=p, w=weight, r=_RECENCY, kinds=", ".join(f"'{k}'" for k in kinds))
        for n, (p, kinds) in enumerate(((1, ("order", "customer")), (1, ("customer", "nation")), (11, ("nation", "region"))))
    ]
    rows = " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)
    return f", rows AS ({rows}), best AS (SELECT id, max(priority) AS p FROM rows GROUP BY id) SELECT id, min_by(name, ordinal) AS name, round(sum(score), 6) AS score FROM rows JOIN best USING (id) WHERE priority = p GROUP BY id ORDER BY sum(score) DESC, id LIMIT 30"


add("r5_federated_search", on_graph(lambda g: _rounded(search.federated_search(_layers(g), "p1", "signup a", None, search.SearchConfig(limit=30), NOW), "id", "name")), _federated_sql(0.1))
add("r9_federated_keyword", on_graph(lambda g: _rounded(search.federated_keyword(_layers(g), "p1", "signup a", 30, NOW), "id", "name")), _federated_sql(0.0))
add(
    "r10_all_scopes", on_graph(lambda g: search.all_scopes_search([(g, "p1"), (g, "p2"), (g, "p1")], "asia europe", 20).select("id", "name", "score")),
    f", k AS (SELECT * FROM ({keyword_sql(['asia', 'europe'], 'p1', 20)}) UNION ALL SELECT * FROM ({keyword_sql(['asia', 'europe'], 'p2', 20)}) UNION ALL SELECT * FROM ({keyword_sql(['asia', 'europe'], 'p1', 20)})) SELECT id, min(name) AS name, sum(score) AS score FROM k GROUP BY id",
)
add("r13_personal_review", on_graph(lambda g: search.personal_review(g, 15, True, "[purchase]").select("id", "name")), "SELECT id, name FROM entity e WHERE EXISTS (SELECT 1 FROM observation o WHERE o.linked AND o.entity_id = e.id AND contains(o.content, '[purchase]')) ORDER BY created_at DESC NULLS LAST, id LIMIT 15")

# ---------------------------------------------------------------- reports

_RUNS = """SELECT CASE WHEN event_type = 'error' THEN 0 WHEN event_id % 2 = 0 THEN 0 ELSE 512 END AS preflight_bytes, CAST(user_id % 17 AS INTEGER) AS turns,
CAST(event_id % 1000 AS BIGINT) AS total_tokens, CAST(event_id % 333 AS BIGINT) AS duration_ms,
CASE WHEN event_id % 5 = 0 THEN -1.0E0 ELSE (event_id % 7) / 7.0E0 END AS exploration_ratio, event_type = 'error' AS has_errors FROM events"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_RUNS.replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


_SUMMARY = f"""SELECT preflight_bytes > 0 AS enabled, count(*) AS runs, round(avg(turns), 6) AS turns, round(avg(total_tokens), 6) AS tokens, round(avg(duration_ms), 6) AS duration_ms,
round(avg(CASE WHEN exploration_ratio >= 0 THEN exploration_ratio END), 6) AS exploration, round(avg(CASE WHEN has_errors THEN 1.0 ELSE 0.0 END), 6) AS error_rate FROM ({_RUNS}) GROUP BY 1"""
add("a8_perf_summary", lambda spark, sf_dir: perf.rounded(perf.summary(_runs(spark, sf_dir))), _SUMMARY, graph=False)
add(
    "a9_perf_delta", lambda spark, sf_dir: perf.delta(perf.summary(_runs(spark, sf_dir))),
    f"WITH s AS ({_SUMMARY}), o AS (SELECT * FROM s WHERE NOT enabled), e AS (SELECT * FROM s WHERE enabled) "
    + " UNION ALL ".join(f"SELECT '{m}' AS metric, round(o.{m}, 4) AS \"off\", round(e.{m}, 4) AS \"on\", round(CASE WHEN o.{m} <> 0 THEN (e.{m} - o.{m}) / o.{m} * 100 END, 2) AS delta_pct FROM o, e" for m in perf.METRICS),
    graph=False,
)


# ---------------------------------------------------------------- extraction and conversion over the tables


def _extraction(spark: SparkSession, sf_dir: str, table: str, path: str, content: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    rows = spread(rows, "p_partkey") if table == "part" else rows
    rows = rows.select(F.expr(path).alias("rel_path"), F.expr(content).cast("binary").alias("content"))
    return files.extract_files(rows).entities.select("rel_path", "id", "name", "type")


def _pages_as_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extraction(spark, sf_dir, "pages", "concat('p/', page_id, '.html')", "html")


_SOURCES = """concat('# Part ', p_partkey, '\n\n## ', p_name, '\n\n```mermaid\ngraph TD\nA[', p_brand, '] --> B{', p_type, '}\n```\n')"""
add("ex16_markdown_topics", lambda spark, sf_dir: _extraction(spark, sf_dir, "part", "concat('docs/', p_partkey, '.md')", _SOURCES))
add("ex17_html_outline", _pages_as_entities)
_YAML_TEXT = "concat('kind: ', p_brand, '\nmetadata:\n  name: ', p_name, '\nspec:\n  size: ', p_size, '\n')"
add("ex18_yaml_names", lambda spark, sf_dir: _extraction(spark, sf_dir, "part", "concat('k8s/', p_partkey, '.yaml')", _YAML_TEXT))
_PY_TEXT = "concat('import os\n\ndef run_', p_partkey, '():\n    helper(1)\n\ndef helper(x):\n    return os.getcwd()\n\nclass Part', p_partkey, ':\n    pass\n')"
add(
    "ex3_python_source", lambda spark, sf_dir: _extraction(spark, sf_dir, "part", "concat('src/', p_partkey, '.py')", _PY_TEXT),
    "WITH f AS (SELECT concat('src/', p_partkey, '.py') AS rel_path, p_partkey AS k FROM part) "
    "SELECT rel_path, concat('file:', rel_path) AS id, rel_path AS name, 'file' AS type FROM f UNION ALL SELECT rel_path, 'import:os', 'os', 'import' FROM f "
    "UNION ALL SELECT rel_path, concat('function:', rel_path, ':run_', k), concat('run_', k), 'function' FROM f UNION ALL SELECT rel_path, concat('function:', rel_path, ':helper'), 'helper', 'function' FROM f "
    "UNION ALL SELECT rel_path, concat('type:', rel_path, ':Part', k), concat('Part', k), 'type' FROM f", graph=False,
)


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log per user, made of its events, in the layout of a service log."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), F.when(F.col("event_type") == "error", " ERROR").otherwise("  INFO"), F.lit(" 1 --- [main] app.Service : "), F.when(F.col("event_type") == "error", "app.FailError: value").otherwise(F.col("event_type")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", line.alias("line")))), lambda x: x["line"]), "\n")
    return e.groupBy("user_id").agg(text.alias("log_text")).select(F.concat(F.lit("logs/"), F.col("user_id").cast("string"), F.lit(".log")).alias("path"), "log_text")


add(
    "ex32_service_logs",
    lambda spark, sf_dir: files.parse_logs(_logs(spark, sf_dir), 2024).select("path", "lines", "errors", "warnings", F.size("entities").cast("long").alias("entities")),
    "SELECT concat('logs/', user_id, '.log') AS path, count(*) AS lines, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors, CAST(0 AS BIGINT) AS warnings, "
    "count(DISTINCT CASE WHEN event_type = 'error' THEN CAST(ts AS DATE) END) AS entities FROM events GROUP BY user_id",
    graph=False,
)
add("md2_html_to_markdown", lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", converted(F.lit("p.html"), F.col("html").cast("binary")).alias("c")).select("page_id", "c.markdown", "c.error"))
_CSV = "concat('name,size\n', p_name, ',', p_size, '\n')"
add(
    "md3_csv_to_markdown",
    lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", converted(F.lit("t.csv"), F.expr(_CSV).cast("binary")).alias("c")).select("p_partkey", "c.markdown"),
    "SELECT p_partkey, concat('| ', rpad('name', w, ' '), ' | size |', chr(10), '| ', repeat('-', w), ' | ---- |', chr(10), '| ', rpad(p_name, w, ' '), ' | ', rpad(CAST(p_size AS VARCHAR), 4, ' '), ' |', chr(10)) AS markdown "
    "FROM (SELECT *, CAST(greatest(4, length(p_name)) AS INTEGER) AS w FROM part)",
    graph=False,
)
add("md4_json_to_markdown", lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", converted(F.lit("e.json"), F.col("props").cast("binary")).alias("c")).select("event_id", "c.markdown"))
add(
    "md5_text_passthrough", lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", converted(F.lit("d.txt"), F.col("text").cast("binary")).alias("c")).select("doc_id", F.md5(F.col("c.markdown").cast("binary")).alias("h")),
    "SELECT doc_id, md5(text) AS h FROM documents", graph=False,
)
add("ex26_normalise_whitespace", lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.md5(strings.normalise_whitespace(F.col("text")).cast("binary")).alias("h")))
add(
    "sc4_byte_and_char_lengths", lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.char_length("text").cast("long").alias("chars")),
    "SELECT doc_id, strlen(text) AS bytes, length(text) AS chars FROM documents", graph=False,
)
add(
    "sc5_summary_line", lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", strings.summary_line(F.col("text")).alias("line")),
    "SELECT doc_id, CASE WHEN length(t) > 300 THEN concat(left(t, 300), '…') ELSE t END AS line FROM (SELECT doc_id, trim(split_part(text, chr(10), 1)) AS t FROM documents)", graph=False,
)
add(
    "sc7_path_parts", lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", strings.base_name(F.col("url")).alias("base"), strings.extension(F.lower("url")).alias("ext")),
    "SELECT page_id, regexp_extract(url, '[^/]*$') AS base, regexp_extract(lower(url), '\\.[^./]*$') AS ext FROM pages", graph=False,
)



def on_table(table: str, f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


add(
    "r6_cosine_to_first", lambda spark, sf_dir: (lambda e: _rounded(e.crossJoin(F.broadcast(e.where("vec_id = 0").select(F.col("embedding").alias("q")))).select("vec_id", search.cosine(F.col("embedding"), F.col("q")).alias("score")), "vec_id"))(spark.read.parquet(f"{sf_dir}/embeddings.parquet")),
    "SELECT e.vec_id, round(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(f.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) "
    "* sqrt(list_dot_product(CAST(f.embedding AS DOUBLE[]), CAST(f.embedding AS DOUBLE[])))), 6) AS score FROM embeddings e, embeddings f WHERE f.vec_id = 0",
    graph=False,
)
add("s1_bag_union", on_graph(lambda g: search.keyword_hits(g, "p1", "urgent", 30).unionByName(search.keyword_hits(g, "p1", "signup", 30)).select("id", "score")), f"SELECT id, score FROM ({keyword_sql(['urgent'], 'p1', 30)}) UNION ALL SELECT id, score FROM ({keyword_sql(['signup'], 'p1', 30)})")
add("s3_edge_set", on_graph(lambda g: g.relation.select("from_id", "to_id", "rel_type").dropDuplicates()), "SELECT DISTINCT from_id, to_id, rel_type FROM relation")
add(
    "w1_top_two_by_time", on_graph(lambda g: search.top_observations(g, g.entity.where("project_id = 'p2'"), 2).select("entity_id", F.array_join(F.transform("observations", lambda o: F.concat_ws(" ", o["id"], o["content"])), ", ").alias("newest"))),
    ", o AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC NULLS LAST, id) AS k FROM observation WHERE linked AND entity_id IN (SELECT id FROM entity WHERE project_id = 'p2')) "
    "SELECT entity_id, string_agg(concat(id, ' ', content), ', ' ORDER BY k) AS newest FROM o WHERE k <= 2 GROUP BY entity_id",
)
add("r12_preflight_hits", on_graph(lambda g: search.keyword_hits(g, "p1", "high click", 16).select("id", "type", "name")), f"SELECT id, type, name FROM ({keyword_sql(['high', 'click'], 'p1', 16)})")
add("sc1_words", on_table("benchmark", lambda d: d.select("item_id", F.size(strings.words(F.col("text"))).cast("long").alias("n"))), "SELECT item_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM benchmark", graph=False)
add("sc3_trim_end", on_table("events", lambda d: d.select("event_id", strings.trim_end(F.concat("event_type", F.lit(" \t\r"))).alias("t"))), "SELECT event_id, event_type AS t FROM events", graph=False)
add("sc8_unquoted", on_table("part", lambda d: d.select("p_partkey", strings.unquoted(F.concat(F.lit('"'), "p_name", F.lit('"'))).alias("t"))), "SELECT p_partkey, p_name AS t FROM part", graph=False)
add("sc9_regex_captures", on_table("events", lambda d: d.select("event_id", F.regexp_extract("props", r'"k": ?(\d+)', 1).alias("k"))), "SELECT event_id, regexp_extract(props, '\"k\": ?(\\d+)', 1) AS k FROM events", graph=False)
add("sc14_day_and_minute", on_table("events", lambda d: d.select("event_id", strings.day(F.col("ts")).alias("day"), strings.minute(F.col("ts")).alias("minute"))), "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%d-%H:%M') AS minute FROM events", graph=False)
add(
    "sc15_age_in_days", on_table("orders", lambda d: d.select("o_orderkey", F.round((F.unix_micros(F.lit(NOW).cast("timestamp")) - F.unix_micros(F.col("o_orderdate").cast("timestamp"))) / 8.64e10, 6).alias("days"))),
    f"SELECT o_orderkey, round((epoch_us({_NOW}) - epoch_us(o_orderdate)) / 8.64e10, 6) AS days FROM orders", graph=False,
)
add("sc20_escape_pipes", on_table("part", lambda d: d.select("p_partkey", strings.escape_pipes(F.concat_ws("|", "p_name", "p_brand")).alias("t"))), "SELECT p_partkey, concat(p_name, '\\|', p_brand) AS t FROM part", graph=False)
add("sc22_natural_id", on_table("part", lambda d: d.select("p_partkey", strings.natural_id(F.col("p_name"), F.col("p_brand")).alias("id"))), "SELECT p_partkey, sha256(concat(p_name, chr(0), p_brand)) AS id FROM part", graph=False)
_SCOPE = files.Scope("s", include=("https:/**/*", "http:/**/*"), exclude=("**/*top", "http:/**/*"))
add("src6_scope_predicate", on_table("pages", lambda d: d.select("page_id", F.regexp_replace("url", "//+", "/").alias("p")).select("page_id", _SCOPE.predicate(F.col("p")).alias("inside"))), "SELECT page_id, starts_with(url, 'https:') AND NOT ends_with(url, 'top') AS inside FROM pages", graph=False)
add(
    "ex22_make_targets", lambda spark, sf_dir: _extraction(spark, sf_dir, "part", "concat(p_partkey, '/Makefile')", "concat('V := 1\nt', p_partkey, ': dep\n\tcc\nall:\n')").where("type <> 'file'"),
    "SELECT concat(p_partkey, '/Makefile') AS rel_path, concat('function:', p_partkey, '/Makefile:t', p_partkey) AS id, concat('t', p_partkey) AS name, 'function' AS type FROM part "
    "UNION ALL SELECT concat(p_partkey, '/Makefile'), concat('type:', p_partkey, '/Makefile:V'), 'V', 'type' FROM part", graph=False,
)
add(
    "ex19_schema_names", lambda spark, sf_dir: _extraction(spark, sf_dir, "part", "concat('s/', p_partkey, '.schema.json')", """concat('{"title": "T', p_partkey, '", "$defs": {"D": {}}}')""").where("type = 'type'").select("rel_path", "name"),
    "SELECT concat('s/', p_partkey, '.schema.json') AS rel_path, concat('T', p_partkey) AS name FROM part UNION ALL SELECT concat('s/', p_partkey, '.schema.json'), 'D' FROM part", graph=False,
)
add(
    "md1_dispatch", on_table("part", lambda d: d.select("p_partkey", converted(F.concat(F.lit("f."), F.element_at(F.array(*map(F.lit, ("txt", "xml", "zip"))), (F.col("p_partkey") % 3 + 1).cast("int"))), F.col("p_name").cast("binary")).alias("c")).select("p_partkey", "c.markdown", F.col("c.error").isNotNull().alias("failed"))),
    "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN concat('```xml', chr(10), p_name, chr(10), '```') END AS markdown, p_partkey % 3 = 2 AS failed FROM part", graph=False,
)

# ---------------------------------------------------------------- streams


def _streamed(make: Callable[[DataFrame], DataFrame], label: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = (spark.conf.get("spark.checkpoint.dir", None) or "/tmp/spindle-checkpoints").rstrip("/")
        return log_stream.run_available(make(log_stream.read_events(spark, sf_dir)), f"{folder}/stream-{label}-{uuid.uuid4().hex}")

    return run


add("st1_dedup_errors", _streamed(lambda e: log_stream.dedup_errors(e).select("user_id", "event_type", "hour"), "st1"), "SELECT DISTINCT user_id, event_type, date_trunc('hour', ts) AS hour FROM events", graph=False)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid keyword search with the newest observations of each hit."""
    g = testgraph.load(spark, sf_dir)
    hits = search.hybrid_search(g, "p1", "urgent signup", None, search.SearchConfig(), NOW)
    return search.with_top_observations(g, hits)
