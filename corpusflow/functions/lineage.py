"""Cutting lineage in loops; lookups and sequences that stand very uneven keys."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, ``spark.checkpoint.dir``.

    Only a session on one machine may go without one and gets a temporary folder. On a cluster
    every executor would write to its own disk, so a missing setting is an error there.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="corpusflow-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df`` in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: columns can be pruned."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


# Rows a key may have before it counts as hot.
HOT_ROWS = 500_000


def hot_keys(rows: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows: at most one per ``hot_rows`` rows."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") > hot_rows).select(key)


def lookup(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    hot: DataFrame | None = None,
    identity: Column | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``rows`` left join ``table``, whose ``key`` is unique, however many rows share a key.

    Adaptive execution does not split a join whose other side comes out of an aggregate,
    so hot keys are looked up by broadcast, without moving their rows; there is at most
    one per ``hot_rows`` rows. All other keys are small groups and are shuffled.

    ``hot`` may give the entries of the hot keys when the caller has counted already.
    ``identity`` is an expression of the key's type that is unique per row and no key; with
    it the rows are read once (hot rows are spread by it), otherwise twice.
    """
    values = [name for name in table.columns if name != key]

    def packed(df: DataFrame, key_name: str, name: str) -> DataFrame:
        return df.select(F.col(key).alias(key_name), F.struct(*values).alias(name))

    if hot is None:
        hot = hot_keys(rows, key, hot_rows).join(table, key, "left")
    hot = F.broadcast(packed(hot, "_hot_key", "_hot"))
    # NULL can be a hot key too.
    is_hot = F.col(key).eqNullSafe(F.col("_hot_key"))
    if identity is None:
        found = rows.join(hot, is_hot).select(*rows.columns, "_hot.*")
        others = rows.join(hot, is_hot, "left_anti").join(table, key, "left")
        return found.unionByName(others.select(*found.columns))
    marked = rows.join(hot, is_hot, "left").withColumn(
        "_key", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(identity)
    )
    return marked.join(packed(table, "_key", "_cold"), "_key", "left").select(
        *rows.columns,
        *[F.coalesce(F.col(f"_hot.{v}"), F.col(f"_cold.{v}")).alias(v) for v in values],
    )


def in_sequence(
    df: DataFrame,
    keys: list[str],
    order: str,
    tokens: Column,
    neighbours: tuple[str, ...] = (),
    block_size: int = 1024,
) -> DataFrame:
    """Number and prefix-sum the rows of every key without putting a key in one task.

    ``order`` is a non-negative integer column, unique within a key. Rows are cut into
    blocks of ``block_size`` order values; each block is a bounded group of its own and
    only one summary row per block is carried along the key. Adds

    * ``seq``: 0-based position within the key,
    * ``start``: sum of ``tokens`` over the earlier rows,
    * ``prev`` / ``next``: the ``neighbours`` columns (and ``_tokens``) of the rows before
      and after, as structs.
    """
    rows = df.withColumns(
        {"_tokens": tokens, "_block": F.floor(F.col(order) / F.lit(block_size))}
    )
    row = F.struct(order, "_tokens", *neighbours)
    along_key = Window.partitionBy(*keys).orderBy("_block")
    blocks = (
        rows.groupBy(*keys, "_block")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.sum("_tokens").alias("_sum"),
            F.min(row).alias("_first"),
            F.max(row).alias("_last"),
        )
        .select(
            *keys,
            "_block",
            _before(F.col("_n"), along_key).alias("_seq_offset"),
            _before(F.col("_sum"), along_key).alias("_start_offset"),
            F.lag("_last").over(along_key).alias("_block_before"),
            F.lead("_first").over(along_key).alias("_block_after"),
        )
    )
    in_block = Window.partitionBy(*keys, "_block").orderBy(order)
    return (
        rows.join(blocks, [*keys, "_block"])
        .withColumns(
            {
                "seq": F.col("_seq_offset") + F.row_number().over(in_block) - 1,
                "start": F.col("_start_offset") + _before(F.col("_tokens"), in_block),
                "prev": F.coalesce(F.lag(row).over(in_block), F.col("_block_before")),
                "next": F.coalesce(F.lead(row).over(in_block), F.col("_block_after")),
            }
        )
        .drop("_block", "_seq_offset", "_start_offset", "_block_before", "_block_after")
    )


def _before(value: Column, window: Window) -> Column:
    """Sum of ``value`` over the earlier rows of an ordered window."""
    return F.coalesce(
        F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
