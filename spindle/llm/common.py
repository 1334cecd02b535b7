"""What the operators share: reading tables, whitespace rules and tables written to shared storage."""

from __future__ import annotations

import atexit
import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The characters that separate words: U+0020 and U+0009 to U+000D, no others.
SPACES = " \t\n\r\x0b\x0c"

#: Tables written and not yet deleted, by application and owner, and the owner of those that are written now.
_written: dict[tuple[str, str], list[str]] = {}
_owner = [""]


_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}


def row_type(spec: str) -> T.StructType:
    """``"a long, b string"`` as a struct type, without the JVM; ``long[]`` is an array of long."""
    fields = (x.split() for x in spec.split(","))
    return T.StructType([T.StructField(name, T.ArrayType(_TYPES[kind[:-2]]) if kind.endswith("[]") else _TYPES[kind]) for name, kind in fields])


#: Rows that a Python worker gets at once: texts can be long, and a batch of many is held several times over.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH_ROWS``, unless they are that small already."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or one of our own where that is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = "/tmp/spindle-checkpoints"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


@contextmanager
def owned(owner: str) -> Iterator[None]:
    """Tables that are written within belong to ``owner``, who may release them."""
    _owner.append(owner)
    try:
        yield
    finally:
        _owner.pop()


def current_owner() -> str:
    return _owner[-1]


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives the loss of executors.

    Tables live until their owner's :func:`release` or the end of the process.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/spindle-{app}/{label}-{uuid.uuid4().hex}"
    _written.setdefault((app, current_owner()), []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget_shuffles(spark: SparkSession) -> None:
    """Have the shuffle files of steps whose results are written deleted now, not when the driver next collects its garbage."""
    spark.range(1).count()  # the listeners hold the last query, and so its shuffles, until the next one
    gc.collect()
    spark._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession, owner: str = "") -> None:
    """Delete the tables of an owner (by default of all that ran without one); only when no plan reads them any more."""
    for path in _written.pop((spark.sparkContext.applicationId, owner), []):
        _delete(spark, path)


@atexit.register
def _release_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        try:
            for _, owner in list(_written):
                release(spark, owner)
        except Exception:  # the JVM may be gone already at exit; the folder is then the cluster's to clear
            pass


def packed(docs: DataFrame, **own) -> DataFrame:
    """All columns of ``docs`` as one struct, ``row``, beside columns of our own, so that no names clash; ``row.*`` unpacks it."""
    return docs.select(F.struct("*").alias("row"), *(c.alias(n) for n, c in own.items()))


def text_hash(column: str, seed: int = 0):
    """A 64-bit hash of a text; null counts as empty."""
    value = F.coalesce(F.col(column), F.lit(""))
    return F.xxhash64(value) if not seed else F.xxhash64(F.lit(seed), value)


def size_expr(column: str = "text"):
    """Words of a text by the ASCII rule, inside the JVM; null gives 0."""
    spaces = r"[\x20\x09-\x0D]+"
    squeezed = F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.regexp_replace(squeezed, spaces, "")).cast("long")


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts (null: empty) laid end to end, and where each starts, with the end of the last."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def groups(offsets: np.ndarray, most: int):
    """Ranges (i, j) of texts of about ``most`` bytes together; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j
        i = j


_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(0, 2**64, 256, np.uint64)
_PLACE = _RANDOM.integers(0, 2**64, 64, np.uint64) | np.uint64(1)


def segment_hashes(data: np.ndarray, starts: np.ndarray, skip: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each segment (from its start to the next, the first at 0), by byte and place; ``skip`` marks bytes that don't count."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = np.diff(np.append(starts, len(data)))
    where = np.arange(len(data)) - np.repeat(starts, sizes)
    mixed = _BYTE[data]
    mixed *= _PLACE[where & 63]
    if int(sizes.max()) > 64:
        far = np.flatnonzero(where > 63)
        mixed[far] ^= (mixed[far] >> np.uint64(29)) * (where[far] >> 6).astype(np.uint64)
    if skip is not None:
        mixed[skip] = 0
    return np.add.reduceat(mixed, starts)
