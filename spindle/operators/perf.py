"""Reports that compare runs with and without a preflight context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = ("turns", "tokens", "duration_ms", "exploration", "error_rate")


def summary(runs: DataFrame) -> DataFrame:
    """Averages by whether preflight was used. A bucket without runs is zeros; one without any valid ratio has a null ratio.

    ``runs``: preflight_bytes, turns, total_tokens, duration_ms, exploration_ratio (negative: none), has_errors.
    """
    ratio = F.when(F.col("exploration_ratio") >= 0, F.col("exploration_ratio"))
    got = runs.groupBy((F.coalesce(F.col("preflight_bytes"), F.lit(0)) > 0).alias("enabled")).agg(
        F.count("*").alias("runs"), F.avg("turns").alias("turns"), F.avg("total_tokens").alias("tokens"), F.avg("duration_ms").alias("duration_ms"),
        F.avg(ratio).alias("exploration"), F.avg(F.col("has_errors").cast("double")).alias("error_rate"),
    )
    both = runs.sparkSession.range(2).select((F.col("id") == 1).alias("enabled"))
    out = both.join(got, "enabled", "left")
    empty = F.col("runs").isNull()
    return out.select("enabled", F.coalesce("runs", F.lit(0).cast("long")).alias("runs"), *(F.when(empty, 0.0).otherwise(F.col(m)).alias(m) for m in METRICS))


def rounded(s: DataFrame, digits: int = 6) -> DataFrame:
    return s.select("enabled", "runs", *(F.round(m, digits).alias(m) for m in METRICS))


def delta(s: DataFrame) -> DataFrame:
    """One row per metric with its value off and on, and the change in percent (null without a baseline)."""
    pick = lambda m, on: F.max(F.when(F.col("enabled") == on, F.col(m)))
    wide = s.agg(*(pick(m, on).alias(f"{m}_{int(on)}") for m in METRICS for on in (False, True)))
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"{m}_0").alias("off"), F.col(f"{m}_1").alias("on")) for m in METRICS))).alias("r")
    out = wide.select(rows).select("r.*")
    pct = F.when(F.col("off") != 0, (F.col("on") - F.col("off")) / F.col("off") * 100)
    return out.select("metric", F.round("off", 4).alias("off"), F.round("on", 4).alias("on"), F.round(pct, 2).alias("delta_pct"))
