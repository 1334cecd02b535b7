"""A training corpus from raw documents, in five stages, each written as Parquet and read again by the next.

1. documents that the quality classifier rejects go;
2. of each group of near duplicates one document stays;
3. secrets are cut out of the texts;
4. documents are repeated or left out so that sources come to their target weights;
5. the texts become packed sequences of tokens.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spindle.llm import mixing, neardup, packing, quality, secrets
from spindle.llm.common import current_owner, materialise, owned, read_table, release, small_batches

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(f: Stage) -> Stage:
    """A stage deletes what the one before it kept in the shared folder: that one's result is written by then."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        owner = current_owner() or "stages"
        release(spark, owner)
        with owned(owner):
            return f(spark, docs, sf_dir)

    return run_stage


@stage
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_documents(docs, read_table(spark, sf_dir, "labels"))


@stage
def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicate(docs)


@stage
def cut_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_documents(docs)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("secret_scans", cut_secrets),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: No stage but the redaction can be said in SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of the whole table of documents."""
    docs = read_table(spark, sf_dir, "documents")
    name = f"run-{uuid.uuid4().hex}"
    for label, step in STAGES[:-1]:
        with owned(name):
            kept = step(spark, docs, sf_dir)
        with owned(f"{name}-{label}"):
            docs = materialise(kept, f"stage-{label}")
    with owned(name):
        return STAGES[-1][1](spark, docs, sf_dir)
