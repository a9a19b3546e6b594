"""Timings on a stream: one mergeable quantile sketch per event-time window.

A window's state is its count, sum and a KLL sketch, some kilobytes however many requests it has.
Every micro-batch adds the windows it has changed to a log; the last version of a window
counts. Windows merge into longer ones, or into a total, by merging their sketches.

A request later than the watermark is left out: its window has been given up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SKETCH_K = 400
_MEDIAN, _P95 = 0.5, 0.95


def rank_error(k: int = SKETCH_K) -> float:
    """Share of all ranks that a quantile of a sketch is off by, with 99 % confidence."""
    return 2.296 / k**0.9723


def timing_windows(timings: DataFrame, window: str, k: int = SKETCH_K) -> DataFrame:
    """``(window_start, requests, sum_ms, sketch)`` of ``timings(ts, total_ms)``, batch or stream.

    Rows without a time or a total count in no window.
    """
    known = timings.where(F.col("ts").isNotNull() & F.col("total_ms").isNotNull())
    return (
        known.groupBy(F.window("ts", window).alias("window"))
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.sum("total_ms").alias("sum_ms"),
            F.kll_sketch_agg_bigint("total_ms", k).alias("sketch"),
        )
        .select(F.col("window.start").alias("window_start"), "requests", "sum_ms", "sketch")
    )


def timing_stream(
    timings: DataFrame,
    path: str,
    checkpoint: str,
    window: str = "1 hour",
    late: str = "10 minutes",
    k: int = SKETCH_K,
    **trigger: object,
) -> StreamingQuery:
    """Start a query that keeps the windows of ``timings(ts, total_ms)`` in the log at ``path``."""

    def add(changed: DataFrame, batch: int) -> None:
        # A batch that is run again overwrites itself.
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    timed = timings.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    windows = timing_windows(timed, window, k)
    writer = (
        windows.writeStream.outputMode("update")
        .foreachBatch(add)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(**trigger) if trigger else writer).start()


def read_timing_windows(spark: SparkSession, path: str) -> DataFrame:
    """The windows as of the last batch."""
    versions = spark.read.parquet(path)
    last = versions.groupBy("window_start").agg(F.max("batch").alias("batch"))
    return versions.join(last, ["window_start", "batch"]).drop("batch")


def merged_timings(windows: DataFrame, *by: Column) -> DataFrame:
    """Requests, mean, median and 95th percentile of windows put together by ``by``, or of all."""
    grouped = windows.groupBy(*by).agg(
        F.sum("requests").alias("requests"),
        (F.sum("sum_ms") / F.sum("requests")).alias("avg_ms"),
        F.kll_merge_agg_bigint("sketch").alias("sketch"),
    )
    keys = [c for c in grouped.columns if c not in ("requests", "avg_ms", "sketch")]
    return grouped.select(
        *keys,
        "requests",
        "avg_ms",
        F.kll_sketch_get_quantile_bigint("sketch", F.lit(_MEDIAN)).alias("median_ms"),
        F.kll_sketch_get_quantile_bigint("sketch", F.lit(_P95)).alias("p95_ms"),
    )
