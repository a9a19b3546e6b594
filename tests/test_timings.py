from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from corpusflow.streaming import timing_stream

T0 = datetime(2024, 1, 1)
SCHEMA = "ts timestamp, total_ms bigint"


def timings(spark, n, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(T0 + timedelta(seconds=int(s)), int(x)) for s, x in zip(np.sort(rng.integers(0, 20_000, n)), rng.lognormal(6, 1, n), strict=True)]
    return spark.createDataFrame([*rows, (None, 5), (T0, None)], SCHEMA), rows


def within(value, values, share, margin):
    values = np.array(values)
    return (values < value).mean() <= share + margin and (values <= value).mean() >= share - margin


def test_stream_equals_batch_within_the_error(spark, tmp_path):
    df, rows = timings(spark, 6000)
    source = str(tmp_path / "in")
    for part in range(3):
        low, high = T0 + timedelta(seconds=7000 * part), T0 + timedelta(seconds=7000 * (part + 1))
        df.where((F.col("ts") >= low) & (F.col("ts") < high)).coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):  # started again, it goes on where it was
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        timing_stream.timing_stream(
            stream, str(tmp_path / "log"), str(tmp_path / "state"), "1 hour", availableNow=True
        ).awaitTermination()
    windows = timing_stream.read_timing_windows(spark, str(tmp_path / "log"))
    batch = timing_stream.timing_windows(df, "1 hour")
    counts = ["window_start", "requests", "sum_ms"]
    assert sorted(windows.select(counts).collect()) == sorted(batch.select(counts).collect())
    assert windows.agg(F.sum("requests")).first()[0] == 6000
    margin = 3 * timing_stream.rank_error()
    for r in timing_stream.merged_timings(windows, F.col("window_start")).collect():
        own = [x for t, x in rows if r["window_start"] <= t < r["window_start"] + timedelta(hours=1)]
        assert r["requests"] == len(own) and abs(r["avg_ms"] - np.mean(own)) < 1e-6
        assert within(r["median_ms"], own, 0.5, margin) and within(r["p95_ms"], own, 0.95, margin)
    [total] = timing_stream.merged_timings(windows).collect()
    every = [x for _, x in rows]
    assert within(total["median_ms"], every, 0.5, margin) and within(total["p95_ms"], every, 0.95, margin)


def test_few_requests_are_exact_and_none_gives_no_window(spark):
    df = spark.createDataFrame([(T0, x) for x in (5, 1, 9)], SCHEMA)
    [row] = timing_stream.merged_timings(timing_stream.timing_windows(df, "1 day")).collect()
    assert (row["requests"], row["avg_ms"], row["median_ms"], row["p95_ms"]) == (3, 5.0, 5, 9)
    assert timing_stream.timing_windows(df.where("false"), "1 day").count() == 0


def test_error_falls_with_the_size_of_the_sketch():
    assert abs(timing_stream.rank_error(200) - 0.0133) < 1e-4
    assert timing_stream.rank_error(800) < timing_stream.rank_error(200) / 3.5
