"""A stored graph: Parquet snapshots, a log of changes, one writer and any number of readers.

A manifest names the snapshot and the change files of a version, and is replaced in one step, so readers see whole
versions. A read folds the changes into the snapshot: the last change of a key wins.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from datetime import datetime, timezone
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import schema
from .graph import Graph

_SCHEMAS = {"entity": schema.ENTITY, "observation": schema.OBSERVATION, "relation": schema.RELATION}
_KEYS = {"entity": ("project_id", "id"), "observation": ("id",), "relation": ("from_id", "to_id", "rel_type", "seq")}


class StoreError(RuntimeError):
    pass


class Store:
    """SRC14 to SRC17, CRUD1 to CRUD16 over a folder. ``read_only`` stores need no lock and reject changes."""

    def __init__(self, spark: SparkSession, folder: str, relation_types: tuple[str, ...] = schema.RELATION_TYPES, read_only: bool = False, width: int | None = None) -> None:
        self.spark, self.folder, self.relation_types, self.read_only, self.width = spark, Path(folder), relation_types, read_only, width
        if read_only and not (self.folder / "manifest.json").exists():
            raise StoreError(f"no store at {folder}")
        if not read_only:
            self.folder.mkdir(parents=True, exist_ok=True)
            try:
                os.close(os.open(self.folder / "lock", os.O_CREAT | os.O_EXCL))
            except FileExistsError:
                raise StoreError(f"{folder} is open for writing elsewhere") from None
            if not (self.folder / "manifest.json").exists():
                self._publish({"version": 0, "seq": 0, "snapshot": {}, "changes": {t: [] for t in _SCHEMAS}})

    def close(self) -> None:
        if not self.read_only:
            (self.folder / "lock").unlink(missing_ok=True)

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    # -- versions
    def manifest(self) -> dict:
        return json.loads((self.folder / "manifest.json").read_text())

    def _publish(self, manifest: dict) -> None:
        new = self.folder / f"manifest-{uuid.uuid4().hex}"
        new.write_text(json.dumps(manifest))
        os.replace(new, self.folder / "manifest.json")

    def table(self, name: str) -> DataFrame:
        """The current rows: the snapshot with the changes folded in."""
        m, shape = self.manifest(), _SCHEMAS[name]
        path = m["snapshot"].get(name)
        rows = self.spark.read.option("mergeSchema", "true").schema(shape).parquet(str(self.folder / path)) if path else self.spark.createDataFrame([], shape)
        files = [str(self.folder / f) for f in m["changes"][name]]
        if not files:
            return rows
        changes = self.spark.read.parquet(*files)
        # the changes are few against the snapshot: they are ranked alone, and the snapshot loses the keys that they touch
        keys = list(_KEYS[name])
        newest = Window.partitionBy(*keys).orderBy(F.desc("_seq"))
        latest = changes.withColumn("_k", F.row_number().over(newest)).where("_k = 1")
        touched = latest.select(*(F.col(k).alias(f"_{k}") for k in keys))
        same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
        put = latest.where("_op = 'put'").drop("_k", "_seq", "_op")
        return rows.join(touched, same, "left_anti").unionByName(put)

    def graph(self) -> Graph:
        return Graph(self.table("entity"), self.table("observation"), self.table("relation"))

    def _append(self, name: str, rows: DataFrame, op: str = "put") -> None:
        if self.read_only:
            raise StoreError("the store is open for reading only")
        m = self.manifest()
        path = f"changes/{name}-{uuid.uuid4().hex}"
        rows.select(*_SCHEMAS[name].names).withColumns({"_seq": F.lit(m["seq"]).cast("long"), "_op": F.lit(op)}).write.parquet(str(self.folder / path))
        m["changes"][name].append(path)
        m["seq"] += 1
        m["version"] += 1
        self._publish(m)

    def _row(self, table: str, /, **values) -> DataFrame:
        return self.spark.createDataFrame([tuple(values.get(c) for c in _SCHEMAS[table].names)], _SCHEMAS[table])

    def scratch(self, rows: DataFrame) -> DataFrame:
        """``rows``, written beside the store so that they are computed once; until :meth:`drop_scratch`."""
        path = f"scratch/{uuid.uuid4().hex}"
        rows.write.parquet(str(self.folder / path))
        return self.spark.read.schema(rows.schema).parquet(str(self.folder / path))

    def drop_scratch(self) -> None:
        shutil.rmtree(self.folder / "scratch", ignore_errors=True)

    def compact(self) -> None:
        """Write a new snapshot without changes behind it."""
        self.replace({t: self.table(t) for t in _SCHEMAS})

    def replace(self, tables: dict[str, DataFrame]) -> None:
        """SRC8 to SRC10: bulk load; all tables change in one step. Relations are partitioned by type."""
        if self.read_only:
            raise StoreError("the store is open for reading only")
        m = self.manifest()
        version = m["version"] + 1
        snapshot, changes = dict(m["snapshot"]), {t: list(c) for t, c in m["changes"].items()}
        for name, rows in tables.items():
            path = f"{name}/v={version}"
            w = rows.select(*_SCHEMAS[name].names).write
            (w.partitionBy("rel_type") if name == "relation" else w).parquet(str(self.folder / path))
            snapshot[name], changes[name] = path, []
        self._publish(m | {"version": version, "snapshot": snapshot, "changes": changes})

    def reindex(self, project: str, entities: DataFrame, relations: DataFrame, observations: DataFrame, preserve_manual: DataFrame | None = None) -> None:
        """SRC17: all that a project had goes (but for ``preserve_manual`` ids), the new rows come; readers see either state."""
        g = self.graph()
        gone = g.entity.where(F.col("project_id") == project)
        if preserve_manual is not None:
            gone = gone.join(preserve_manual, "id", "left_anti")
        ids = gone.select("id")
        stay = lambda rows, c: rows.join(ids.withColumnRenamed("id", c), c, "left_anti")
        relation = stay(stay(g.relation, "from_id"), "to_id").unionByName(relations)
        kept = g.entity.join(gone.select("project_id", "id"), ["project_id", "id"], "left_anti")
        self.replace({"entity": kept.unionByName(entities), "observation": stay(g.observation, "entity_id").unionByName(observations), "relation": relation})

    # -- entities
    def _now(self) -> datetime:
        return datetime.now(timezone.utc)

    def create_entity(self, name: str, kind: str, project: str, now: datetime | None = None) -> str:
        """CRUD1: always a new entity, with an id of its own."""
        eid, now = str(uuid.uuid4()), now or self._now()
        self._append("entity", self._row("entity", id=eid, name=name, type=kind, project_id=project, created_at=now, updated_at=now))
        return eid

    def _require(self, entity_id: str, project: str):
        rows = self.table("entity").where((F.col("id") == entity_id) & (F.col("project_id") == project)).head(1)
        if not rows:
            raise LookupError(f"entity not found: {entity_id}")
        return rows[0]

    get_entity = _require

    def delete_entity(self, entity_id: str, project: str, cascade: bool = False) -> None:
        """CRUD5: edges go; observations stay, cut off, unless ``cascade`` deletes them."""
        self._require(entity_id, project)
        g = self.graph()
        self._append("relation", g.relation.where((F.col("from_id") == entity_id) | (F.col("to_id") == entity_id)), "delete")
        said = g.observation.where(F.col("entity_id") == entity_id)
        self._append("observation", said if cascade else said.withColumn("linked", F.lit(False)), "delete" if cascade else "put")
        self._append("entity", g.entity.where((F.col("id") == entity_id) & (F.col("project_id") == project)), "delete")

    # -- observations
    def create_observation(self, entity_id: str, content: str, project: str, now: datetime | None = None) -> str:
        """CRUD6."""
        self._require(entity_id, project)
        oid = str(uuid.uuid4())
        self._append("observation", self._row("observation", id=oid, entity_id=entity_id, content=content, created_at=now or self._now(), linked=True))
        return oid

    def delete_observation(self, observation_id: str, entity_id: str, project: str) -> None:
        """CRUD8: nothing happens if there is none."""
        self._require(entity_id, project)
        self._append("observation", self.table("observation").where((F.col("id") == observation_id) & (F.col("entity_id") == entity_id) & F.col("linked")), "delete")

    # -- relations
    def create_relation(self, from_id: str, to_id: str, rel_type: str, project: str) -> None:
        """CRUD9, CRUD13: the type is checked, parallel edges are kept apart; without both ends nothing is made."""
        schema.check_relation_type(rel_type, self.relation_types)
        ends = self.table("entity").where(F.col("project_id") == project).where(F.col("id").isin(from_id, to_id)).select("id").distinct().count()
        if ends == len({from_id, to_id}):
            self._append("relation", self._row("relation", from_id=from_id, to_id=to_id, rel_type=rel_type, seq=self.manifest()["seq"]))

    def delete_relation(self, from_id: str, to_id: str, rel_type: str, project: str) -> None:
        """CRUD11: all parallel edges."""
        schema.check_relation_type(rel_type, self.relation_types)
        self._append("relation", self.table("relation").where((F.col("from_id") == from_id) & (F.col("to_id") == to_id) & (F.col("rel_type") == rel_type)), "delete")

    # -- embeddings
    def set_embedding(self, table: str, row_id: str, vector: list[float]) -> None:
        """CRUD14: a later version of the row; caches are by version, so none goes stale."""
        if self.width is not None and len(vector) != self.width:
            raise ValueError(f"embeddings have {self.width} components, not {len(vector)}")
        rows = self.table(table).where(F.col("id") == row_id)
        self._append(table, rows.withColumn("embedding", F.array(*(F.lit(float(x)).cast("float") for x in vector))))

    def unembedded(self, table: str) -> DataFrame:
        """CRUD15, R14: id and the text to embed, ``type: name`` of entities and the content of observations."""
        text = F.concat_ws(": ", "type", "name") if table == "entity" else F.col("content")
        return self.table(table).where(F.col("embedding").isNull()).select("id", text.alias("text"))

    def embed_all(self, table: str, embed) -> None:
        """``embed`` maps a pandas Series of texts to one of vectors; all rows without one get theirs in one job."""
        vector = F.pandas_udf(embed, "array<float>")
        todo = self.unembedded(table).select("id", vector("text").alias("_v"))
        rows = self.table(table).join(todo, "id").withColumn("embedding", F.col("_v")).drop("_v")
        self._append(table, rows)
