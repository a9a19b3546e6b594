"""Reading and writing the corpus tables.

JSON files are for exchange: one array per file, or one object per line, of any size (see
``json_items``). Malformed files are errors. Between jobs tables are Parquet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow.sources import json_items, published

PAGE_SCHEMA = (
    "source_url string, title string, "
    "sections array<struct<section_title: string, text: string>>"
)
CHUNK_SCHEMA = (
    "id string, content string, source_url string, title string, section string, "
    "chunk_index int"
)


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _file_system(spark, path)
    return fs.exists(hadoop_path)


def _ordered(blocks: DataFrame, schema: str, as_row: Callable[[str], dict]) -> DataFrame:
    """``(ord, ...)`` per element; ``ord`` follows file, then position."""
    rows = json_items.parsed(json_items.elements(blocks), schema, as_row)
    place = F.shiftleft("file_ord", 32) + F.col("pos")
    return rows.select(place.alias("ord"), *rows.columns[2:])


def _pages(blocks: DataFrame) -> DataFrame:
    rows = _ordered(blocks, PAGE_SCHEMA, json_items.objects_with("source_url", "sections"))
    return rows.withColumnRenamed("ord", "page_ord")


def _urls(blocks: DataFrame) -> DataFrame:
    return _ordered(blocks, "url string", json_items.objects_with("url", plain="url"))


def _chunks(blocks: DataFrame) -> DataFrame:
    rows = _ordered(blocks, CHUNK_SCHEMA, json_items.objects_with("id", "content"))
    return rows.select(
        *rows.columns[1:], F.col("ord").alias("page_ord"), F.lit(0).alias("section_index")
    )


def _answers(blocks: DataFrame) -> DataFrame:
    def entry(text: str) -> dict:
        found = json_items.pair(text)
        if not isinstance(found["value"], dict) or "answer" not in found["value"]:
            raise ValueError("no entry with an answer")
        return {"question": found["key"], "answer": found["value"]["answer"]}

    entries = json_items.elements(blocks, "{")
    return json_items.parsed(entries, "question string, answer string", entry).select(
        "question", "answer"
    )


def pages_from_json(files: DataFrame) -> DataFrame:
    """Ingested pages from ``files(file_ord, value)`` holding JSON arrays or lines of pages."""
    return _pages(json_items.blocks_of(files))


def urls_from_json(files: DataFrame) -> DataFrame:
    """``(ord, url)`` from JSON arrays of strings, or lines of objects with a ``url``."""
    return _urls(json_items.blocks_of(files))


def chunks_from_json(files: DataFrame) -> DataFrame:
    """Chunks from JSON arrays or lines.

    The exchange format has no page and section order; the position is kept as
    ``page_ord`` with ``section_index`` 0.
    """
    return _chunks(json_items.blocks_of(files))


def answers_from_json(objects: DataFrame) -> DataFrame:
    """``(question, answer)`` from JSON objects ``{question: {"answer": ...}}``, one per row.

    A malformed object raises.
    """
    numbered = objects.select(F.monotonically_increasing_id().alias("file_ord"), "value")
    return _answers(json_items.blocks_of(numbered))


def read_pages(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    """Ingested pages with ``page_ord``, from JSON files or a stored table."""
    if format != "json":
        return spark.read.format(format).load(path)
    return _pages(json_items.read_blocks(spark, path))


def read_urls(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    """``(ord, url)`` from JSON files or a stored table."""
    if format != "json":
        return spark.read.format(format).load(path)
    return _urls(json_items.read_blocks(spark, path))


def read_chunks(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    """Chunks from JSON files or a stored table."""
    if format != "json":
        return spark.read.format(format).load(path)
    return _chunks(json_items.read_blocks(spark, path))


def read_answer_cache(spark: SparkSession, path: str) -> DataFrame:
    """``(question, answer)`` from cache files; a path that does not exist is empty."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "question string, answer string")
    return _answers(json_items.read_blocks(spark, path))


def answer_cache_objects(
    answers: DataFrame, entries_per_object: int | None = None
) -> DataFrame:
    """``answers(ord, question, answer)`` as ``(part, n, json)`` cache objects.

    A question has one answer, its last. By default the cache is one object, as its reader in
    the browser wants it; ``entries_per_object`` cuts a large one by counted position.
    """
    latest = answers.groupBy("question").agg(
        F.max("ord").alias("ord"), F.max_by("answer", "ord").alias("answer")
    )
    entry = F.struct("question", F.struct("answer").alias("value"))
    part = F.lit(0).cast("long")
    if entries_per_object is not None:
        # Numbered along ranges of ord: rows per range are counted, no task sees them all.
        latest = _numbered(latest, "ord")
        part = F.floor(F.col("_number") / entries_per_object)
    return (
        latest.groupBy(part.alias("part"))
        .agg(F.array_sort(F.collect_list(entry)).alias("entries"))
        .select(
            "part",
            F.size("entries").alias("n"),
            F.to_json(F.map_from_entries("entries")).alias("json"),
        )
    )


def _numbered(df: DataFrame, order: str, block: int = 4096) -> DataFrame:
    """``df`` with ``_number``, its position by ``order`` (an integer column without ties)."""
    blocked = df.withColumn("_block", F.floor(F.col(order) / block))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        blocked.groupBy("_block")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy("_block").orderBy(order)
    return blocked.join(starts, "_block").withColumn(
        "_number", F.col("_start") + F.row_number().over(inside) - 1
    )


def write_answer_cache(
    answers: DataFrame, path: str, entries_per_object: int | None = None
) -> None:
    """Write cache objects, one per file."""
    objects = answer_cache_objects(answers, entries_per_object)
    objects.select("json").repartition(F.xxhash64("json")).write.option(
        "maxRecordsPerFile", 1
    ).mode("overwrite").text(path)


def read_table(spark: SparkSession, path: str, spread_by: str) -> DataFrame:
    """A stored Parquet table.

    A table with fewer scan tasks than cores (a small one in few row groups) is spread by
    ``spread_by``, so that costly column rules use all cores; a large one is read as is.
    """
    table = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if table.rdd.getNumPartitions() < cores:
        return table.repartition(cores, spread_by)
    return table


def write_table(df: DataFrame, path: str, format: str = "parquet") -> None:
    """Overwrite a table of URLs, pages, chunks or reports."""
    df.write.mode("overwrite").format(format).save(path)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder."""
    fs, hadoop_path = _file_system(spark, path)
    return [status.getPath().getName() for status in fs.listStatus(hadoop_path)]


def delete_path(spark: SparkSession, path: str) -> None:
    fs, hadoop_path = _file_system(spark, path)
    fs.delete(hadoop_path, True)


def replace_table(df: DataFrame, path: str) -> int:
    """Replace a table as a whole and return how many rows it held before.

    The new rows become the current version in one step when they are complete (see
    ``published``), so a job that fails at any point leaves the old table as it was.
    """
    spark = df.sparkSession
    old = published.read_state(spark, path)
    before = published.published(spark, path).count() if old else 0
    published.publish(df, path)
    return before


def load_documents(embedded: DataFrame, path: str) -> int:
    """Full refresh of the document index from embedded chunks; read it with ``published``.

    Rows without a vector are left out; ``id`` is a new number, unique by partition and row
    (with gaps); the chunk's own id and index are not stored. Returns the old row count.
    """
    rows = embedded.where(F.col("embedding").isNotNull()).select(
        F.monotonically_increasing_id().alias("id"),
        "content", "embedding", "source_url", "title", "section",
        F.current_timestamp().alias("created_at"),
    )
    return replace_table(rows, path)
