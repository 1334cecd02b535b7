"""A graph over the driver's tables, said once in SQL that both engines read, so that every query on it has an oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph

_PARITY = "CASE WHEN {k} % 2 = 0 THEN 'p1' ELSE 'p2' END"


def _entity(kind: str, key: str, name: str, table: str, when: str = "TIMESTAMP '2000-01-01 00:00:00'", join: str = "") -> str:
    return (
        f"SELECT concat('{kind}:', CAST({key} AS STRING)) AS id, {name} AS name, '{kind}' AS type, {_PARITY.format(k=key)} AS project_id, "
        f"CAST({when} AS TIMESTAMP) AS created_at, CAST({when} AS TIMESTAMP) AS updated_at FROM {table} {join}"
    )


ENTITY_SQL = " UNION ALL ".join(
    (
        _entity("region", "r_regionkey", "r_name", "region"),
        _entity("nation", "n_nationkey", "n_name", "nation"),
        _entity(
            "customer", "c_custkey", "c_name", "customer", "coalesce(o.newest, TIMESTAMP '2000-01-01 00:00:00')",
            "LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS newest FROM orders GROUP BY o_custkey) o ON o.o_custkey = c_custkey",
        ),
        _entity("supplier", "s_suppkey", "s_name", "supplier"),
        _entity("part", "p_partkey", "p_name", "part"),
        _entity("order", "o_orderkey", "concat('Order ', o_orderpriority, ' ', CAST(o_orderkey AS STRING))", "orders", "o_orderdate"),
    )
)

OBSERVATION_SQL = """
SELECT concat('ev:', CAST(event_id AS STRING)) AS id, concat('customer:', CAST(user_id AS STRING)) AS entity_id,
  concat('[', event_type, '] value=', CAST(CAST(floor(value) AS BIGINT) AS STRING)) AS content, CAST(ts AS TIMESTAMP) AS created_at, TRUE AS linked FROM events
UNION ALL
SELECT concat('on:', CAST(o_orderkey AS STRING)), concat('order:', CAST(o_orderkey AS STRING)),
  concat('[', o_orderpriority, '] status ', o_orderstatus), CAST(o_orderdate AS TIMESTAMP), o_orderkey % 10 <> 0 FROM orders
UNION ALL
SELECT concat('cv:', CAST(conv_id AS STRING), ':', CAST(turn AS STRING)), concat('conversation:', CAST(conv_id AS STRING)),
  coalesce(text, ''), TIMESTAMP '2024-01-01 00:00:00', FALSE FROM conversations
"""

RELATION_SQL = """
SELECT concat('customer:', CAST(c_custkey AS STRING)) AS from_id, concat('nation:', CAST(c_nationkey AS STRING)) AS to_id, 'BELONGS_TO' AS rel_type FROM customer
UNION ALL SELECT concat('supplier:', CAST(s_suppkey AS STRING)), concat('nation:', CAST(s_nationkey AS STRING)), 'BELONGS_TO' FROM supplier
UNION ALL SELECT concat('nation:', CAST(n_nationkey AS STRING)), concat('region:', CAST(n_regionkey AS STRING)), 'BELONGS_TO' FROM nation
UNION ALL SELECT concat('order:', CAST(l_orderkey AS STRING)), concat('part:', CAST(l_partkey AS STRING)), 'CONTAINS' FROM lineitem
UNION ALL SELECT DISTINCT concat('part:', CAST(l_partkey AS STRING)), concat('supplier:', CAST(l_suppkey AS STRING)), 'DEPENDS_ON' FROM lineitem
UNION ALL SELECT concat('customer:', CAST(o_custkey AS STRING)), concat('order:', CAST(o_orderkey AS STRING)), 'RELATES_TO' FROM orders
"""

#: For DuckDB, in front of a query.
WITH = f"WITH entity AS ({ENTITY_SQL}), observation AS ({OBSERVATION_SQL}), relation AS ({RELATION_SQL}) "

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "conversations")


def load(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph; each table is read with the columns that a plan needs, since the views are only SQL over scans."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    run = lambda sql, names: spark.sql(_placed(sql, names), **{t: frames[t] for t in names})
    entity = run(ENTITY_SQL, ("region", "nation", "customer", "supplier", "part", "orders"))
    observation = run(OBSERVATION_SQL, ("events", "orders", "conversations"))
    relation = run(RELATION_SQL, ("customer", "supplier", "nation", "lineitem", "orders"))
    none = F.lit(None).cast("array<float>")
    return Graph(entity.withColumn("embedding", none), observation.withColumn("embedding", none), relation.withColumn("seq", F.lit(0).cast("long")))


def _placed(sql: str, names: tuple[str, ...]) -> str:
    """The SQL with its tables as parameters, so no view has to be registered."""
    import re

    for t in names:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return sql


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as entities: vector search needs them beside the graph."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    project = F.when(F.col("vec_id") % 2 == 0, "p1").otherwise("p2")
    return e.select(
        F.concat(F.lit("vec:"), F.col("vec_id").cast("string")).alias("id"), F.concat(F.lit("vector "), F.col("label").cast("string")).alias("name"),
        F.lit("vector").alias("type"), project.alias("project_id"), F.lit("2000-01-01").cast("timestamp").alias("updated_at"), "embedding",
    )
