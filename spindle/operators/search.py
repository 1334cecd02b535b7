"""Ranked search: keywords, vectors, both, and merged over layers."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph


@dataclass(frozen=True)
class SearchConfig:
    """``keyword_weight`` is accepted and, as documented, takes no part in the score. A limit of 0 means all defaults."""

    keyword_weight: float = 0.4
    recency_weight: float = 0.1
    limit: int = 20

    def resolved(self) -> SearchConfig:
        if self.limit < 0:
            raise ValueError("limit must not be negative")
        return SearchConfig() if self.limit == 0 else self


@dataclass(frozen=True)
class Layer:
    """One graph of a federation. Names must differ; ``project`` overrides the searched project."""

    name: str
    graph: Graph
    priority: int
    project: str | None = None


def tokens(query: str) -> list[str]:
    """SC1: lower-case words, repeats kept; empty and blank queries are errors of their own."""
    if not query:
        raise ValueError("query is empty")
    out = query.lower().split()
    if not out:
        raise ValueError("query has no words")
    return out


def _any_token(column: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.lower(column).contains(w)
    return hit


def keyword_hits(g: Graph, project: str, query: str, limit: int) -> DataFrame:
    """Entities whose name, or an observation of theirs, contains a word; the newest ``limit``, each scored 1."""
    words = tokens(query)
    limit = limit if limit > 0 else 20
    said = g.linked().where(_any_token(F.col("content"), words)).select(F.col("entity_id").alias("id")).distinct().withColumn("said", F.lit(True))
    own = g.entity.where(F.col("project_id") == project)
    hits = own.join(said, "id", "left").where(_any_token(F.col("name"), words) | F.coalesce(F.col("said"), F.lit(False)))
    return hits.select("id", "name", "type", "project_id", "updated_at").orderBy(F.desc_nulls_last("updated_at"), "id").limit(limit).withColumn("score", F.lit(1.0))


def top_observations(g: Graph, ids: DataFrame, n: int = 3) -> DataFrame:
    """R3 and, for one id, R2: the newest ``n`` observations of each entity (by id alone, whatever its project), as a list.

    The window's rank limit is pushed below its shuffle, and only the ids asked for are ranked.
    """
    newest = Window.partitionBy("entity_id").orderBy(F.desc_nulls_last("created_at"), "id")
    picked = g.linked().join(ids.select(F.col("id").alias("entity_id")).distinct(), "entity_id", "left_semi").withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= n)
    return picked.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "id", "content"))), lambda o: o.dropFields("_k")).alias("observations"))


def with_top_observations(g: Graph, hits: DataFrame, n: int = 3) -> DataFrame:
    lists = top_observations(g, hits, n).withColumnRenamed("entity_id", "id")
    return hits.join(lists, "id", "left")


def cosine(a: Column, b: Column) -> Column:
    """Over the shorter length, in double; 0 where either is zero."""
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    num = lambda v: v.cast("double")
    dot = total(F.zip_with(a, b, lambda x, y: num(x) * num(y)))
    na, nb = (F.sqrt(total(F.transform(v, lambda x: num(x) * num(x)))) for v in (a, b))
    return F.when((n > 0) & (na > 0) & (nb > 0), dot / (na * nb)).otherwise(0.0)


def vector_hits(g: Graph, project: str, vector: list[float], limit: int) -> DataFrame:
    """Exact cosine neighbours among the project's embedded entities."""
    limit = limit if limit > 0 else 20
    q = F.array(*(F.lit(float(x)) for x in vector))
    rows = g.entity.where((F.col("project_id") == project) & F.col("embedding").isNotNull())
    scored = rows.select("id", "name", "type", "project_id", "updated_at", cosine(F.col("embedding"), q).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(limit)


def recency(updated_at: Column, now: datetime) -> Column:
    """exp(-age in days / 30) within [0, 1]; no time gives 0."""
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(updated_at.cast("timestamp"))) / 8.64e10
    return F.when(updated_at.isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.exp(-age / 30))))


def hybrid_search(g: Graph, project: str, query: str, vector: list[float] | None, config: SearchConfig, now: datetime) -> DataFrame:
    """Keyword hits (1.0 each) and cosine added up by entity, plus weighted recency; every match is called hybrid."""
    if not query and not vector:
        raise ValueError("a query or a vector is needed")
    c = config.resolved()
    parts = []
    if query:
        parts.append(keyword_hits(g, project, query, 2 * c.limit))
    if vector:
        parts.append(vector_hits(g, project, vector, 2 * c.limit))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    merged = both.groupBy("id", "name", "type", "project_id", "updated_at").agg(F.sum("score").alias("score"))
    score = F.col("score") + c.recency_weight * recency(F.col("updated_at"), now)
    return merged.withColumn("score", score).withColumn("match_type", F.lit("hybrid")).orderBy(F.desc("score"), "id").limit(c.limit)


def merge_layers(results: list[tuple[int, int, DataFrame]], limit: int | None) -> DataFrame:
    """(ordinal, priority, hits) of each layer. The highest priority wins an id; equal ones add their scores.

    The payload is that of the first such layer. One union and one aggregation, whatever the number of layers.
    """
    if not results:
        raise ValueError("no layers")
    rows = None
    for ordinal, priority, hits in results:
        part = hits.withColumns({"_ordinal": F.lit(ordinal), "_priority": F.lit(priority)})
        rows = part if rows is None else rows.unionByName(part)
    payload = F.struct(*[c for c in results[0][2].columns if c not in ("id", "score")])
    per = rows.groupBy("id", "_priority").agg(F.sum("score").alias("score"), F.min_by(payload, "_ordinal").alias("p"))
    best = per.groupBy("id").agg(F.max_by(F.struct("score", "p"), "_priority").alias("b"))
    out = best.select("id", "b.score", "b.p.*").orderBy(F.desc("score"), "id")
    return out if limit is None else out.limit(limit)


def federated_search(layers: list[Layer], project: str, query: str, vector: list[float] | None, config: SearchConfig, now: datetime) -> DataFrame:
    """Every layer's own top-k first, then the merge. A layer whose tables can't be analysed is skipped with a warning."""
    if len({x.name for x in layers}) != len(layers):
        raise ValueError("layer names must differ")
    c = config.resolved()
    found = []
    for i, x in enumerate(layers):
        try:
            hits = hybrid_search(x.graph, x.project or project, query, vector, c, now)
            hits.schema  # noqa: B018  analysis, without running anything
        except Exception as e:
            if isinstance(e, ValueError):
                raise
            warnings.warn(f"layer {x.name} is skipped: {type(e).__name__}: {str(e)[:200]}", stacklevel=2)
            continue
        found.append((i, x.priority, hits))
    return merge_layers(found, c.limit)


def federated_keyword(layers: list[Layer], project: str, query: str, limit: int, now: datetime) -> DataFrame:
    """Only a limit is passed on, so recency has no weight."""
    return federated_search(layers, project, query, None, replace(SearchConfig(), recency_weight=0.0, limit=limit), now)


def federated_vector(layers: list[Layer], project: str, vector: list[float], limit: int, now: datetime) -> DataFrame:
    """R9."""
    return federated_search(layers, project, "", vector, replace(SearchConfig(), recency_weight=0.0, limit=limit), now)


def all_scopes_search(scopes: list[tuple[Graph, str]], query: str, limit: int) -> DataFrame:
    """Scores added up by id over all scopes, without priorities or a limit; ordered by score and id."""
    rows = None
    for g, project in scopes:
        part = keyword_hits(g, project, query, limit).select("id", "name", "type", "score")
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("id").agg(F.min(F.struct("name", "type")).alias("p"), F.sum("score").alias("score")).select("id", "p.*", "score").orderBy(F.desc("score"), "id")


def scope_layers(primary: Graph, extra: list[tuple[str, Graph]] = (), personal: Graph | None = None) -> list[Layer]:
    """Extra layers have priorities 1, 2, ..., the primary their number and 10, the personal one 0; the primary is last."""
    layers = [Layer("personal", personal, 0, "personal")] if personal is not None else []
    layers += [Layer(name, g, i + 1) for i, (name, g) in enumerate(extra)]
    return [*layers, Layer("primary", primary, len(extra) + 10)]


def personal_review(g: Graph, limit: int, agent_only: bool = False, marker: str = "[VIA:mcp]") -> DataFrame:
    """The newest entries; those an agent wrote carry the marker in an observation. The filter comes before the limit."""
    rows = g.entity
    if agent_only:
        rows = rows.join(g.linked().where(F.col("content").contains(marker)).select(F.col("entity_id").alias("id")), "id", "left_semi")
    return rows.orderBy(F.desc_nulls_last("created_at"), "id").limit(limit)


def preflight_context(g: Graph, project: str, task: str, limit: int = 16) -> str:
    """The text that a task starts with."""
    hits = with_top_observations(g, keyword_hits(g, project, task, limit)).orderBy(F.desc_nulls_last("updated_at"), "id").collect()
    lines = [f"# Context for: {task}"]
    for h in hits:
        lines.append(f"- {h['type']}: {h['name']} ({h['id']})")
        lines += [f"  - {o['content']}" for o in h["observations"] or []]
    return "\n".join(lines) if hits else f"No context found for: {task}"
