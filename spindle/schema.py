"""Schemas of the graph's tables and of what the extractors return."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _TS, _B = T.StringType(), T.LongType(), T.TimestampType(), T.BooleanType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


ENTITY = _struct(
    ("id", _S), ("name", _S), ("type", _S), ("project_id", _S), ("created_at", _TS), ("updated_at", _TS), ("embedding", T.ArrayType(T.FloatType())), ("layer", _S)
)
OBSERVATION = _struct(("id", _S), ("entity_id", _S), ("content", _S), ("created_at", _TS), ("embedding", T.ArrayType(T.FloatType())), ("linked", _B))
RELATION = _struct(("from_id", _S), ("to_id", _S), ("rel_type", _S), ("seq", _L))
SOURCE_FILE = _struct(("rel_path", _S), ("ext", _S), ("content", T.BinaryType()), ("size", _L))

EXTRACTED = _struct(
    ("entities", T.ArrayType(_struct(("ordinal", T.IntegerType()), ("id", _S), ("name", _S), ("type", _S)))),
    ("relations", T.ArrayType(_struct(("from_id", _S), ("to_id", _S), ("rel_type", _S)))),
    ("calls", T.ArrayType(_struct(("from_id", _S), ("callee_name", _S), ("rel_path", _S)))),
    ("observations", T.ArrayType(_struct(("entity_id", _S), ("content", _S)))),
    ("error", _S),
)

#: Relation types that the command line accepts.
RELATION_TYPES = ("BELONGS_TO", "CALLS", "CAUSED_BY", "CONTAINS", "DEPENDS_ON", "DOCUMENTS", "FIXES", "IMPLEMENTS", "IMPORTS", "RELATES_TO", "SUPERSEDES", "TESTS")


def check_relation_type(rel_type: str, allowed: tuple[str, ...] = RELATION_TYPES) -> str:
    if rel_type not in allowed:
        raise ValueError(f"unknown relation type {rel_type!r}; one of: {', '.join(allowed)}")
    return rel_type
