"""The page table as a log: every micro-batch adds its own rows and nothing is rewritten.

A table is a folder with ``log/batch=N`` per micro-batch, at most one compacted ``base-...``
and the file ``_current`` (see ``sources.published``), which says up to which batch the log is
complete, where positions go on, and which base holds the batches up to some number.

* ``append_batch`` writes one batch. A batch that is run again overwrites itself, and one that
  was cut off is not seen, as ``_current`` still names the one before.
* ``read_page_log`` merges on read: the last version of every URL, at its first position.
* ``compact`` writes the merged rows as a new base, while batches may go on being added.

A page's position is the one of its URL's first row: the position in its batch plus the end
of all batches before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusflow.functions import text as t
from corpusflow.sources.published import read_state, write_state
from corpusflow.sources.tables import delete_path, folder_names

COLUMNS = ("source_url", "title", "sections")
_EMPTY = {"batch": -1, "offset": 0, "next": 0, "base": None, "base_batch": -1}


def append_batch(new: DataFrame, path: str, batch: int) -> None:
    """Add ``new(page_ord, source_url, title, sections)`` as batch number ``batch``.

    Numbers rise from 0, with or without gaps; the last one may be repeated after a failure.
    """
    spark = new.sparkSession
    state = read_state(spark, path) or dict(_EMPTY)
    if batch < state["batch"]:
        raise ValueError(f"batch {batch} after batch {state['batch']}")
    again = batch == state["batch"]
    offset = state["offset"] if again else state["next"]
    folder = f"{path}/log/batch={batch}"
    rows = new.select(
        (F.col("page_ord") + F.lit(offset)).alias("position"),
        F.monotonically_increasing_id().alias("row"),
        t.drop_trailing_slash(F.col("source_url")).alias("url_key"),
        *COLUMNS,
    )
    rows.write.mode("overwrite").parquet(folder)
    last = spark.read.schema(rows.schema).parquet(folder).agg(F.max("position")).first()[0]
    write_state(
        spark,
        path,
        {**state, "batch": batch, "offset": offset, "next": offset if last is None else last + 1},
    )


def _versions(spark: SparkSession, path: str, state: dict) -> DataFrame | None:
    """All rows that count: the base, and the batches since; narrow columns can be pruned."""
    parts = []
    if state["base"] is not None:
        parts.append(spark.read.parquet(f"{path}/{state['base']}"))
    if state["batch"] > state["base_batch"]:
        log = spark.read.parquet(f"{path}/log")
        since = F.col("batch").between(state["base_batch"] + 1, state["batch"])
        parts.append(log.where(since).withColumn("first_position", F.col("position")))
    if not parts:
        return None
    columns = ["url_key", "batch", "position", "row", "first_position", *COLUMNS]
    rows = [part.select(*columns) for part in parts]
    return rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])


def _merged(versions: DataFrame) -> DataFrame:
    """The last version of each URL. Texts of earlier versions are left behind by a narrow pass."""
    place = F.struct("batch", "position", "row")
    last = (
        versions.select("url_key", "batch", "position", "row", "first_position")
        .groupBy("url_key")
        .agg(F.max(place).alias("last"), F.min("first_position").alias("first_position"))
        .select("last.*", "first_position")
    )
    return versions.drop("first_position").join(last, ["batch", "position", "row"])


def read_page_log(spark: SparkSession, path: str) -> DataFrame:
    """``(url_key, page_ord, source_url, title, sections)``: the table as of the last batch."""
    state = read_state(spark, path)
    if state is None:
        raise FileNotFoundError(f"no page table at {path}")
    versions = _versions(spark, path, state)
    if versions is None:
        raise FileNotFoundError(f"no batch in the page table at {path}")
    return _merged(versions).select("url_key", F.col("first_position").alias("page_ord"), *COLUMNS)


def compact(spark: SparkSession, path: str) -> None:
    """Write what readers see as a new base. What it replaces stays until ``drop_merged``."""
    state = read_state(spark, path)
    if state is None or state["batch"] == state["base_batch"]:
        return
    base = f"base-{uuid.uuid4().hex}"
    _merged(_versions(spark, path, state)).write.parquet(f"{path}/{base}")
    # Batches added meanwhile are after state["batch"] and stay in the log.
    now = read_state(spark, path)
    write_state(spark, path, {**now, "base": base, "base_batch": state["batch"]})


def drop_merged(spark: SparkSession, path: str) -> None:
    """Delete batches that the base holds, when no reader is on them any more."""
    state = read_state(spark, path)
    if state is None or state["base"] is None or state["batch"] == state["base_batch"]:
        return  # the last batch may still be run again
    for name in folder_names(spark, f"{path}/log"):
        if name.startswith("batch=") and int(name[6:]) <= state["base_batch"]:
            delete_path(spark, f"{path}/log/{name}")


def upsert_log_stream(
    pages: DataFrame, path: str, checkpoint: str, compact_every: int = 0, **trigger: object
) -> StreamingQuery:
    """Start a query that adds every micro-batch of ``pages`` to the log at ``path``.

    With ``compact_every`` the log is compacted after every so many batches.
    """

    def add(batch: DataFrame, number: int) -> None:
        append_batch(batch, path, number)
        if compact_every and (number + 1) % compact_every == 0:
            compact(batch.sparkSession, path)

    writer = pages.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
