"""Operator 4: best-fit packing by patterns.

Documents become pieces of at most 1024 tokens. The pieces' lengths form a histogram, whose size doesn't depend on the
corpus; patterns (a few lengths that fill a sequence) get repeat counts by non-negative least squares on it, rounded
down, and a best-fit pass over the histogram packs what is left. The plan is a short list of (pattern, repeats); each
piece finds its place from its rank among the pieces of its length, so no piece moves and no group is collected.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, row_type
from .tokens import default_path, encoder

LENGTH = 1024
END_ID = 2
#: Pieces of one length are ranked in buckets of about so many.
BUCKET_PIECES = 100_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def cut(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """Start and length of each piece of a document of n ids: only the first may be shorter."""
    first = (n - 1) % length + 1
    return [(0, first), *((s, length) for s in range(first, n, length))]


def to_pieces(docs: DataFrame, text: str = "text", tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece of each whole document (null text: empty), with the CRC-32 of its ids. One pass, no shuffle."""
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_all
        for batch in batches:
            rows: list[tuple] = []
            for key, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                rows += [(key, k, s, n, zlib.crc32(ids[s : s + n])) for k, (s, n) in enumerate(cut(len(ids), length))]
            columns = list(zip(*rows)) or [[]] * len(_PIECES)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECES)], schema=_PIECES)

    return docs.select(F.col("doc_id").cast("long"), F.col(text)).mapInArrow(run, row_type(PIECES))


def enumerate_patterns(counts: dict[int, int], length: int = LENGTH, tries: int = 6) -> list[tuple[int, ...]]:
    """Patterns of two to four documents that fill a sequence as well as the lengths present allow.

    For each length, its best partners; for shorter sums also a third and fourth, by best fit from several starts.
    """
    present = sorted(counts)
    patterns: set[tuple[int, ...]] = set()

    def fit(room: int) -> int | None:
        k = bisect_right(present, room)
        return present[k - 1] if k else None

    common = sorted(present, key=lambda x: -counts[x])[:24]
    for a in present:
        if a == length:
            patterns.add((a,))
            continue
        partners = {fit(length - a)}
        k = bisect_right(present, length - a)
        partners |= set(present[max(0, k - tries) : k]) | {x for x in common if x <= length - a}
        partners |= {present[int(k * f)] for f in (0.25, 0.5, 0.75) if k}
        for b in partners - {None}:
            chosen, room = [a, b], length - a - b
            for _ in range(2):
                c = fit(room)
                if c is None:
                    break
                chosen.append(c)
                room -= c
            patterns.add(tuple(sorted(chosen, reverse=True)))
    return sorted(patterns)


def nonnegative_least_squares(rows: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """min |ax - b| over x >= 0, where column j of a counts the rows listed in ``rows[j]`` (index len(b) is none).

    Projected gradients with momentum, restarted when it overshoots; a is only used as products, never built.
    """
    n = len(b)
    forth = lambda x: np.bincount(rows.ravel(), np.repeat(x, rows.shape[1]), n + 1)[:n]
    back = lambda r: np.append(r, 0.0)[rows].sum(axis=1)
    v = np.ones(len(rows))
    for _ in range(30):
        v = back(forth(v))
        v /= max(np.linalg.norm(v), 1e-300)
    step = 1 / max(float(v @ back(forth(v))) * 1.02, 1e-12)
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(rounds):
        grad = back(forth(y) - b)
        new = np.maximum(0, y - step * grad)
        if float(grad @ (new - x)) > 0:
            t, new = 1.0, np.maximum(0, x - step * back(forth(x) - b))
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


def plan(counts: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and repeats that use every piece of the histogram exactly once.

    Fitted repeats are rounded down and never exceed what is left. The rest goes by best fit over the histogram: the
    longest length left takes the longest that still fit, as often as all of them allow, which uses up a length each time.
    """
    left = {k: int(v) for k, v in counts.items() if v > 0}
    made: list[tuple[tuple[int, ...], int]] = []

    def use(pattern: tuple[int, ...], times: int) -> None:
        made.append((pattern, times))
        for k in set(pattern):
            left[k] -= times * pattern.count(k)
            if not left[k]:
                del left[k]

    patterns = [p for p in enumerate_patterns(left, length) if sum(p) >= length * 0.98]
    if patterns:
        row = {k: i for i, k in enumerate(sorted(left))}
        a = np.full((len(patterns), max(map(len, patterns))), len(row))
        for j, p in enumerate(patterns):
            a[j, : len(p)] = [row[k] for k in p]
        total = sum(left.values())
        x = nonnegative_least_squares(a, np.array([left[k] for k in row], float) / total) * total
        for j in sorted(range(len(patterns)), key=lambda j: (length - sum(patterns[j]), -x[j])):
            p = patterns[j]
            times = min(int(x[j]), *(left.get(k, 0) // p.count(k) for k in p))
            if times > 0:
                use(p, times)
    present = sorted(left)
    while left:
        first = present[-1]
        chosen, room = {first: 1}, length - first
        while room > 0:
            k = bisect_right(present, room) - 1
            while k >= 0 and chosen.get(present[k], 0) >= left[present[k]]:
                k -= 1
            if k < 0:
                break
            chosen[present[k]] = chosen.get(present[k], 0) + 1
            room -= present[k]
        use(tuple(sorted((k for k, m in chosen.items() for _ in range(m)), reverse=True)), min(left[k] // m for k, m in chosen.items()))
        present = [k for k in present if k in left]
    return made


def slots(made: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length, its places in order of rank: (first rank, first sequence, offset) of each run of repeats."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    seen: dict[int, int] = {}
    sequence = 0
    for pattern, times in made:
        offset = 0
        for k in pattern:
            out.setdefault(k, []).append((seen.get(k, 0), sequence, offset))
            seen[k] = seen.get(k, 0) + times
            offset += k
        sequence += times
    return {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in out.items()}


def pack(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """``pieces`` with sequence_id and offset: every piece has a place, sequences are gapless from 0 and hold at most ``length``.

    Needs the columns of ``PIECES``; others are left out. Equal rows are interchangeable; an empty table gives no rows.
    Two shuffles of some 40 bytes a piece: the ranks within (length, bucket), and the counts of those.
    """
    spark = pieces.sparkSession
    names = [x.split()[0] for x in PIECES.split(", ")]
    rows = materialise(pieces.select(*names, F.spark_partition_id().alias("_part")), "pieces")
    counts = {int(r["length"]): int(r["n"]) for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `length` rows
    if not counts:
        return rows.select(*names).withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    made = plan(counts, length)
    table = spark.sparkContext.broadcast(slots(made))  # bounded by the number of lengths, not of pieces
    n = max(1, math.ceil(sum(counts.values()) / BUCKET_PIECES))
    split = rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "_part"), F.lit(4 * n)))
    sizes = split.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("length", "_bucket").orderBy(*(F.col(c) for c in ("doc_id", "piece", "start", "ids_crc32")))
    ranked = split.join(sizes, ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.row_number().over(own) - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = table.value
        for batch in batches:
            size, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            seq, off = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            for k in np.unique(size).tolist():
                at = np.flatnonzero(size == k)
                first, sequence, offset = where[k]
                run = np.searchsorted(first, rank[at], side="right") - 1
                seq[at], off[at] = sequence[run] + rank[at] - first[run], offset[run]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, "_rank").mapInArrow(place, row_type(PIECES + ", sequence_id long, offset long"))


def pack_documents(docs: DataFrame, text: str = "text", tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """Whole documents as packed pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece of the end id alone; repeated rows are packed each; only documents longer than
    ``length`` are cut; columns other than doc_id and ``text`` are left out; an empty table gives no rows.
    """
    return pack(to_pieces(docs, text, tokenizer, length), length)
