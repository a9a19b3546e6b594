"""Streaming page upsert into a table partitioned by URL bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusflow.functions import text as t
from corpusflow.functions.lineage import cut_lineage
from corpusflow.operators.pages import upsert_pages
from corpusflow.sources.tables import path_exists


def url_bucket(n_buckets: int) -> Column:
    return F.pmod(F.xxhash64(t.drop_trailing_slash(F.col("source_url"))), F.lit(n_buckets))


def upsert_batch(new: DataFrame, path: str, n_buckets: int = 64) -> None:
    """Merge one batch of pages into the table at ``path``.

    Only the buckets the batch touches are read and rewritten, and running a batch twice
    gives the same table.
    """
    spark = new.sparkSession
    new = cut_lineage(new.withColumn("bucket", url_bucket(n_buckets)))
    # At most n_buckets values.
    touched = [row.bucket for row in new.select("bucket").distinct().collect()]
    if not touched:
        return
    if path_exists(spark, path):
        table = spark.read.parquet(path)
        offset = table.agg((F.max("page_ord") + 1).alias("n")).first().n or 0
        existing = table.where(F.col("bucket").isin(touched))
    else:
        offset = 0
        existing = new.where("false")
    merged = upsert_pages(existing, new, offset).withColumn("bucket", url_bucket(n_buckets))
    (
        cut_lineage(merged.drop("url_key"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket")
        .parquet(path)
    )


def upsert_stream(
    pages: DataFrame, path: str, checkpoint: str, n_buckets: int = 64, **trigger: object
) -> StreamingQuery:
    """Start a query that merges every micro-batch of ``pages`` into ``path``."""
    writer = pages.writeStream.foreachBatch(
        lambda batch, _: upsert_batch(batch, path, n_buckets)
    ).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
