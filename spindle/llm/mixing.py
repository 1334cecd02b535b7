"""Operator 10: mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same fractional number of copies. Pairs of documents exchange mass, in words, at
random (each keeps its expectation) until one of the two is integral, so the words of a source are kept exactly until a
single fractional document is left. Each bucket of documents is rounded by itself; what is left of each is combined in
a reduction tree, of bounded fan-in however large a source is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, packed, row_type, size_expr

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
#: Rows of a bucket, on average, and children of a node of the tree.
BUCKET_ROWS = 20_000
FAN_IN = 256


def targets(sizes: list[int], weights: list[float], limit: float = MAX_COPIES) -> list[float]:
    """Shares of the total by weight; what is above ``limit`` times a source's size is shared again by weight until none is."""
    total, stopped = float(sum(sizes)), [s == 0 for s in sizes]
    limit = float(limit)
    out = [0.0] * len(sizes)
    while not all(stopped):
        left = total - sum(limit * s for s, x in zip(sizes, stopped) if x)
        weight = sum(w for w, x in zip(weights, stopped) if not x)
        share = [limit * s if x else left * w / weight for s, w, x in zip(sizes, weights, stopped)]
        over = [not x and v > limit * s for v, s, x in zip(share, sizes, stopped)]
        out = share
        if not any(over):
            break
        stopped = [a or b for a, b in zip(stopped, over)]
        out = [min(v, limit * s) for v, s in zip(share, sizes)]
    return out


def pivotal(fraction: np.ndarray, size: np.ndarray, chance: np.ndarray) -> tuple[np.ndarray, int, float]:
    """Round fractions to 0 or 1 in the order given, keeping the sum of fraction times size.

    Returns the rounded fractions, and the index and fraction of the one left (-1 if none is).
    """
    done = np.zeros(len(size), np.int64)
    held, p, s = -1, 0.0, 0.0
    tiny = 1e-12
    for i, (q, t, u) in enumerate(zip(fraction.tolist(), size.tolist(), chance.tolist())):
        if q <= tiny or q >= 1 - tiny or t <= 0:
            done[i] = int(q > 0.5)
            continue
        if held < 0:
            held, p, s = i, q, t
            continue
        # mass that can go to the held one, until it is 1 or this is 0; and the other way
        up, down = min((1 - p) * s, q * t), min(p * s, (1 - q) * t)
        move = up if u * (up + down) < down else -down
        p, q = p + move / s, q - move / t
        if p <= tiny or p >= 1 - tiny:
            done[held] = int(p > 0.5)
            held, p, s = i, q, t
            if q <= tiny or q >= 1 - tiny:
                done[i], held = int(q > 0.5), -1
        else:
            done[i] = int(q > 0.5)
    return done, held, p


_ROUNDED = "doc_id long, row_key long, source string, size long, bucket long, base long, fraction double, extra long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("source", pa.string()), ("size", pa.int64()), ("bucket", pa.int64()), ("base", pa.int64()), ("fraction", pa.float64()), ("extra", pa.int64())])


def _round_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, source, size): ``extra`` is 0 or 1, or null for the one that is left of a bucket and source.

    A group that goes on in the next batch carries the row that it holds, so memory doesn't grow with a group.
    """
    carried: pa.RecordBatch | None = None
    for batch in batches:
        if carried is not None:
            batch = pa.Table.from_batches([carried, batch]).combine_chunks().to_batches()[0]
        n = len(batch)
        if not n:
            continue
        col = {f: batch.column(i) for i, f in enumerate(batch.schema.names)}
        code = col["source"].dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        bucket = col["bucket"].to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (bucket[1:] != bucket[:-1])))
        fraction = col["fraction"].to_numpy(zero_copy_only=False).copy()
        size = col["size"].to_numpy(zero_copy_only=False)
        chance = col["chance"].to_numpy(zero_copy_only=False)
        extra, left = np.zeros(n, np.int64), np.zeros(n, bool)
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), n]):
            extra[a:b], at, p = pivotal(fraction[a:b], size[a:b], chance[a:b])
            if at >= 0:
                left[a + at], fraction[a + at] = True, p
        last = int(cut[-1])  # the last group may go on: hold back its fractional row
        hold = np.flatnonzero(left[last:]) + last
        keep = np.ones(n, bool)
        keep[hold] = False
        done = pa.RecordBatch.from_arrays(
            [col["doc_id"], col["row_key"], col["source"], col["size"], col["bucket"], col["base"], pa.array(fraction), pa.array(extra, mask=left)], schema=_ARROW
        )
        carried = None
        if len(hold):
            names = batch.schema.names
            arrays = [pa.array(fraction) if f == "fraction" else col[f] for f in names]
            carried = pa.RecordBatch.from_arrays(arrays, schema=batch.schema).take(pa.array(hold))
        yield done.filter(pa.array(keep))
    if carried is not None:
        col = {f: carried.column(i) for i, f in enumerate(carried.schema.names)}
        yield pa.RecordBatch.from_arrays([col[f] for f in ("doc_id", "row_key", "source", "size", "bucket", "base", "fraction")] + [pa.nulls(len(carried), pa.int64())], schema=_ARROW)


def _chance(level: int, seed: int):
    """A number in [0, 1) that depends on nothing but the row, the level and the seed, so reruns agree."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "row_key"), F.lit(1 << 40)) / float(1 << 40)).alias("chance")


def _row_key(text: str):
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.coalesce(F.col(text), F.lit("")))


def _numbered(sources: DataFrame) -> DataFrame:
    """One row per source with its number by code point, null last: sorted by ranges, so no task holds them all."""
    order = [F.col("source").isNull(), F.col("source")]
    spread = materialise(sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "sources")
    counts = sorted((int(r["part"]), int(r["n"])) for r in spread.groupBy("part").agg(F.count("*").alias("n")).collect())  # one row a partition
    before, start = {}, 0
    for part, n in counts:
        before[part], start = start, start + n
    first = F.create_map(*(F.lit(x) for pair in before.items() for x in pair)) if before else F.create_map(F.lit(0), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return spread.withColumn("number", rank + first[F.col("part")]).drop("part")


def source_targets(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: float = MAX_COPIES) -> DataFrame:
    """Per source (of docs with columns source and size): source_size and target, as :func:`targets` gives them.

    Only sums reach the driver: in each round those of the sources that have come to their limit, until no more do.
    """
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    each = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("number") % len(weights) + 1).cast("int"))
    rows = materialise(_numbered(sizes).withColumn("weight", each), "weighted")
    active = rows.where("source_size > 0")
    total = active.agg(F.sum("source_size")).first()[0]
    if total is None:
        return rows.select("source", "source_size", F.lit(0.0).alias("target"))
    left, weight = float(total), active.agg(F.sum("weight")).first()[0]
    stopped = F.lit(False)
    number = 0
    while True:
        share = F.lit(left) * F.col("weight") / F.lit(weight)
        stopped = stopped | (share > limit * F.col("source_size"))
        said = active.agg(F.count_if(stopped), F.sum(F.when(stopped, F.col("source_size")).otherwise(0)), F.sum(F.when(~stopped, F.col("weight")))).first()
        if int(said[0]) == number or said[2] is None:
            break
        number, left, weight = int(said[0]), float(total) - limit * float(said[1]), float(said[2])
        stopped = F.lit(left) * F.col("weight") / F.lit(weight) > limit * F.col("source_size")  # shares only rise: all that stopped still do
    target = F.when(F.col("source_size") <= 0, 0.0).otherwise(F.least(share, limit * F.col("source_size").cast("double")))
    return rows.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, text: str = "text", weights: tuple[float, ...] = WEIGHTS, limit: int = MAX_COPIES, seed: int = 17) -> DataFrame:
    """Copies of every document so that each source's words come to its target: row_key, doc_id, source, size, source_size, target, copies.

    ``docs`` has doc_id, source and ``text``; other columns are left out. Sources go by code point, null last. Null and
    empty texts have size 0 and 0 copies. ``row_key`` hashes doc_id, source and text; repeated rows have one row each,
    interchangeable. An empty table gives no rows. The words of a source differ from its target by at most half of its last
    fractional document, and no document has more than ``limit`` copies.
    """
    spark = docs.sparkSession
    key = _row_key(text).alias("row_key")
    rows = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_expr(text).alias("size"), key), "mix-sizes")
    shares = materialise(source_targets(rows, weights, limit), "mix-targets")
    n = rows.count()
    buckets = max(1, math.ceil(n / BUCKET_ROWS))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    share = rows.join(shares, rows["source"].eqNullSafe(shares["source"])).drop(shares["source"])
    start = share.withColumn("each", F.when(F.col("size") > 0, F.least(each, F.lit(float(limit)))).otherwise(0.0))
    base = F.floor(F.col("each") + 1e-9)
    start = start.select(
        "doc_id", "row_key", "source", "size", F.pmod(F.xxhash64(F.lit(seed), F.when(F.col("size") > 0, F.col("row_key")).otherwise(F.spark_partition_id())), F.lit(buckets)).alias("bucket"),  # rows of no words have no part in the rounding
        base.alias("base"), F.greatest(F.lit(0.0), F.col("each") - base).alias("fraction"), _chance(0, seed),
    )
    parts, level = [], 0
    while True:
        order = [F.col("bucket"), F.col("source").asc_nulls_last(), F.col("size").desc(), F.col("row_key")]
        names = [c for c in start.columns]
        tree = start.repartition("bucket", "source").sortWithinPartitions(*order).select(*names)
        rounded = materialise(tree.mapInArrow(_round_sorted, row_type(_ROUNDED)), f"mix-level{level}")
        parts.append(rounded.where(F.col("extra").isNotNull()))
        left = rounded.where(F.col("extra").isNull())
        if buckets == 1:
            # one fractional document of a source is left, with none to pair it with: the nearer integer
            parts.append(left.withColumn("extra", (F.col("fraction") >= 0.5).cast("long")))
            break
        level, buckets = level + 1, math.ceil(buckets / FAN_IN)
        start = left.withColumn("bucket", F.floor(F.col("bucket") / FAN_IN) if buckets > 1 else F.lit(0).cast("long")).select(*names[:-1], _chance(level, seed))
    copies = parts[0]
    for p in parts[1:]:
        copies = copies.unionByName(p)
    copies = copies.select("doc_id", "row_key", "source", "size", (F.col("base") + F.col("extra")).alias("copies"))
    return copies.join(shares, copies["source"].eqNullSafe(shares["source"])).drop(shares["source"])


def digest(docs: DataFrame) -> DataFrame:
    """The columns that query op10 returns."""
    made = mix(docs)
    return made.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source")


def repeat_documents(docs: DataFrame, text: str = "text", seed: int = 17) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as :func:`mix` says, with all its columns.

    Rows alike in doc_id, source and text come equally often, and together as often as the mix takes them all: where that
    leaves a remainder, some of them come once more.
    """
    made = mix(docs, text, seed=seed)
    total = made.groupBy("doc_id", "row_key").agg(F.sum("copies").alias("copies"), F.count("*").alias("n")).where("copies > 0")
    total = total.select(F.col("doc_id").alias("mixed_id"), F.col("row_key").alias("mixed"), F.floor(F.col("copies") / F.col("n")).alias("each"), (F.col("copies") % F.col("n")).alias("rest"))
    keyed = packed(docs, own_id=F.col("doc_id").cast("long"), own=_row_key(text))
    joined = keyed.join(total, (F.col("own") == F.col("mixed")) & F.col("own_id").eqNullSafe(F.col("mixed_id")))
    several = joined.where("rest > 0").select("row", "own_id", "own", "each", "rest", F.spark_partition_id().alias("part"))
    several = materialise(several, "mix-remainders")  # so that parts stay what they are
    parts = several.groupBy("own_id", "own", "part").agg(F.count("*").alias("k"))
    earlier = Window.partitionBy("own_id", "own").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("own_id").alias("p_id"), F.col("own").alias("p_own"), F.col("part").alias("p_part"), F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("own_id", "own", "part").orderBy(F.lit(0)))
    ranked = several.withColumn("rank", within).join(parts, (F.col("own") == F.col("p_own")) & F.col("own_id").eqNullSafe(F.col("p_id")) & (F.col("part") == F.col("p_part")))
    more = ranked.select("row", (F.col("each") + (F.col("rank") + F.col("before") <= F.col("rest")).cast("long")).alias("times"))
    out = joined.where("rest = 0").select("row", F.col("each").alias("times")).unionByName(more).where("times > 0")
    return out.select("row", F.explode(F.expr("sequence(1L, times)"))).select("row.*")
