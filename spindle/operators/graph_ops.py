"""Point reads, traversals, joins and aggregates on a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph

_NODE = ("id", "name", "type", "project_id")


def get_entity(g: Graph, entity_id: str, project: str) -> DataFrame:
    """CRUD2; :func:`one` turns no row into an error."""
    return g.entity.where((F.col("id") == entity_id) & (F.col("project_id") == project))


def one(rows: DataFrame, entity_id: str):
    found = rows.head(1)
    if not found:
        raise LookupError(f"entity not found: {entity_id}")
    return found[0]


def get_entity_by_name(g: Graph, name: str, project: str) -> DataFrame:
    """CRUD3: at most one; the least id, where several have the name."""
    return g.entity.where((F.col("name") == name) & (F.col("project_id") == project)).orderBy("id").limit(1)


def list_entities(g: Graph, project: str, kind: str = "") -> DataFrame:
    """CRUD4."""
    rows = g.entity.where(F.col("project_id") == project)
    return rows.where(F.col("type") == kind) if kind else rows


def get_observations(g: Graph, entity_id: str, project: str) -> DataFrame:
    """CRUD7: those linked to the entity, if the project has it."""
    owner = g.entity.where((F.col("id") == entity_id) & (F.col("project_id") == project)).select(F.col("id").alias("entity_id"))
    return g.linked().where(F.col("entity_id") == entity_id).join(owner, "entity_id", "left_semi")


def get_relations(g: Graph, entity_id: str, project: str) -> DataFrame:
    """CRUD10: outgoing edges to entities, with their type."""
    own = g.entity.where((F.col("id") == entity_id) & (F.col("project_id") == project)).select(F.col("id").alias("from_id"))
    out = g.relation.where(F.col("from_id") == entity_id).join(own, "from_id", "left_semi")
    return out.join(g.entity.select(F.col("id").alias("to_id"), F.col("name").alias("to_name")), "to_id").select("from_id", "to_id", "rel_type", "to_name")


def traverse(g: Graph, entity_id: str, rel_type: str, project: str) -> DataFrame:
    """CRUD12: targets one hop along a type, in whatever project they are. The type is checked against the catalog."""
    own = g.entity.where((F.col("id") == entity_id) & (F.col("project_id") == project)).select(F.col("id").alias("from_id"))
    out = g.relation.where((F.col("from_id") == entity_id) & (F.col("rel_type") == rel_type)).join(own, "from_id", "left_semi")
    return out.select(F.col("to_id").alias("id")).join(g.entity.select(*_NODE), "id")


def relation_tables(g: Graph) -> DataFrame:
    """SRC16: the relation types present; from partition values where the table is partitioned by type."""
    return g.relation.select("rel_type").distinct()


def count_entities(g: Graph, project: str) -> DataFrame:
    """A1."""
    return g.entity.where(F.col("project_id") == project).agg(F.count("*").alias("n"))


def _both_ends(g: Graph, project: str) -> DataFrame:
    inside = g.entity.where(F.col("project_id") == project).select("id")
    edges = g.relation.join(inside.withColumnRenamed("id", "from_id"), "from_id", "left_semi")
    return edges.join(inside.withColumnRenamed("id", "to_id"), "to_id", "left_semi")


def count_relations(g: Graph, project: str) -> DataFrame:
    """A2: edges of every type with both ends in the project."""
    return _both_ends(g, project).agg(F.count("*").alias("n"))


def count_observations(g: Graph, project: str) -> DataFrame:
    """A3: through the edge, so orphans don't count."""
    owners = g.entity.where(F.col("project_id") == project).select(F.col("id").alias("entity_id"))
    return g.linked().join(owners, "entity_id").agg(F.count("*").alias("n"))


def stats(g: Graph, project: str) -> DataFrame:
    """A4: the three counts in one job."""
    parts = (("entities", count_entities), ("relations", count_relations), ("observations", count_observations))
    out = None
    for name, f in parts:
        row = f(g, project).select(F.lit(name).alias("what"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def edge_groups(g: Graph, more_than: int = 0) -> DataFrame:
    """A6 and, with ``more_than=1``, A7: edges per (from, to, type), counted; P10 filters on the count."""
    return g.relation.groupBy("from_id", "to_id", "rel_type").agg(F.count("*").alias("n")).where(F.col("n") > more_than)


def entities_by_type(g: Graph) -> DataFrame:
    """A5."""
    return g.entity.groupBy("type").agg(F.count("*").alias("n"))


def orphans(g: Graph, kind: str | None = None) -> DataFrame:
    """Entities to which no edge leads."""
    rows = g.entity if kind is None else g.entity.where(F.col("type") == kind)
    return rows.join(g.relation.select(F.col("to_id").alias("id")), "id", "left_anti")


def with_observations(g: Graph) -> DataFrame:
    """J3."""
    return g.entity.select(F.col("id").alias("entity_id"), "name", "type", "project_id").join(g.linked().select("entity_id", F.col("id").alias("obs_id"), "content"), "entity_id")


def hop(g: Graph, rel_type: str | None = None, from_type: str | None = None, to_type: str | None = None) -> DataFrame:
    """J1 and, without a type, J2: one hop between entities."""
    edges = g.relation if rel_type is None else g.relation.where(F.col("rel_type") == rel_type)
    left = g.entity if from_type is None else g.entity.where(F.col("type") == from_type)
    right = g.entity if to_type is None else g.entity.where(F.col("type") == to_type)
    a = left.select(F.col("id").alias("from_id"), F.col("name").alias("from_name"))
    b = right.select(F.col("id").alias("to_id"), F.col("name").alias("to_name"))
    return edges.select("from_id", "to_id", "rel_type").join(a, "from_id").join(b, "to_id")


def load_relations(entities: DataFrame, relations: DataFrame, order: str | None = None) -> DataFrame:
    """SRC9, J8, S3: edges of known entities only, once per (from, to, type)."""
    ids = entities.select("id").distinct()
    kept = relations.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    return kept.select("from_id", "to_id", "rel_type").dropDuplicates()


def first_seen(records: DataFrame, key: str = "id", order: tuple[str, ...] = ("rel_path", "ordinal")) -> DataFrame:
    """Of the records with one key the first in walk order; aggregated, so a frequent key isn't sorted in one task."""
    rest = [c for c in records.columns if c not in (key, *order)]
    pick = F.min(F.struct(*order, *rest)).alias("_first")
    return records.groupBy(key).agg(pick).select(key, "_first.*").select(*records.columns)


def resolve_calls(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """EX20, J7: each call with its target and outcome (resolved, ambiguous, unresolved).

    ``functions``: id, name, rel_path; ``calls``: from_id, callee_name, rel_path. A function of the same file wins; else
    the name must be that of one function anywhere. Equi-joins on ids and on pre-aggregated names.
    """
    same = functions.select(F.col("id").alias("own_id")).distinct()
    names = functions.groupBy(F.col("name").alias("callee_name")).agg(F.count_distinct("id").alias("k"), F.min("id").alias("only_id"))
    wanted = calls.withColumn("own_id", F.concat(F.lit("function:"), F.col("rel_path"), F.lit(":"), F.col("callee_name")))
    hit = wanted.join(same.withColumn("own", F.lit(True)), "own_id", "left").join(names, "callee_name", "left")
    target = F.when(F.col("own"), F.col("own_id")).when(F.col("k") == 1, F.col("only_id"))
    outcome = F.when(F.col("own") | (F.col("k") == 1), "resolved").when(F.col("k") > 1, "ambiguous").otherwise("unresolved")
    return hit.select("from_id", "callee_name", "rel_path", target.alias("to_id"), outcome.alias("outcome"))


def call_counts(resolved: DataFrame) -> DataFrame:
    """A12."""
    n = lambda kind: F.sum((F.col("outcome") == kind).cast("long")).alias(kind)
    return resolved.agg(F.count("*").alias("calls"), n("resolved"), n("ambiguous"), n("unresolved"))
