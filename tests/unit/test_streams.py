import os

from pyspark.sql import functions as F

from spindle.streaming import log_stream as st

SF = "/root/testdata/sf0.001"


def run(spark, stream, tmp_path):
    return st.run_available(stream, f"file://{tmp_path}")


def test_batch_and_stream_agree(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    got = run(spark, st.dedup_errors(st.read_events(spark, SF)), tmp_path / "a")
    want = batch.select("user_id", "event_type", F.date_trunc("hour", "ts").alias("hour")).distinct()
    assert got.select(*want.columns).exceptAll(want).isEmpty() and got.count() == want.count()
    counts = run(spark, st.hourly_counts(st.read_events(spark, SF)), tmp_path / "b")
    assert counts.join(batch.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n")), ["hour", "event_type", "n"], "left_anti").isEmpty() and counts.count() > 100
    sessions = run(spark, st.crash_sessions(st.read_events(spark, SF)), tmp_path / "c").agg(F.sum("events")).first()[0]
    assert 0.9 * batch.count() <= sessions <= batch.count()


def test_state_carries_over_batches(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = [(1, "error"), (2, "error"), (3, "view"), (4, "error"), (5, "click"), (6, "error")]
    for k, part in enumerate((rows[:1], rows[1:4], rows[4:])):
        df = spark.createDataFrame([(i, f"2024-01-01 00:00:0{i}", 7, t) for i, t in part], "event_id long, t string, user_id long, event_type string").select("event_id", F.to_timestamp("t").alias("ts"), "user_id", "event_type")
        df.coalesce(1).write.mode("append").parquet(src)
        for f in os.listdir(src):
            if f.endswith(".parquet") and not f.startswith("k"):
                os.rename(f"{src}/{f}", f"{src}/k{k}-{f}")
                os.utime(f"{src}/k{k}-{f}", (k + 1, k + 1))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = run(spark, st.error_streaks(stream), tmp_path / "out")
    assert sorted((r["ordinal"], r["errors"]) for r in got.collect()) == [(0, 2), (1, 1)]
