"""A property graph as three DataFrames: entities, observations and relations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    """entity(id, name, type, project_id, created_at, updated_at, embedding), observation(id, entity_id, content, created_at, linked), relation(from_id, to_id, rel_type, seq)."""

    entity: DataFrame
    observation: DataFrame
    relation: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.entity.sparkSession

    def linked(self) -> DataFrame:
        """Observations that still hang on an entity."""
        return self.observation.where(F.coalesce(F.col("linked"), F.lit(True)))

    def register(self, prefix: str = "") -> None:
        for name in ("entity", "observation", "relation"):
            getattr(self, name).createOrReplaceTempView(prefix + name)
