"""A stored inverted-file index of vectors: built once, searched without moving documents.

An index is a folder:

* ``centroids``: ``(cell, centroid)``, one row per cell;
* ``vectors``: ``(id, embedding, ..., slot)`` partitioned by ``cell`` and bucketed by ``slot``, a
  bounded part of one cell;
* ``slots``: ``(cell, first_slot, n_slots)``;
* ``settings``: one row with the dimension, the number of rows and buckets, and the probes.

Few queries are broadcast with their cells and read only the partitions of those cells. Many
queries are taken in turns of a fixed size: they are sent to the slots of their cells, where the
documents lie, and meet them by bucket. Queries move, documents never do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow import config
from corpusflow.functions import vectors as v
from corpusflow.functions.lineage import stored
from corpusflow.operators.retrieve import (
    BLOCK_BYTES,
    assign_cells,
    blocks_in_turn,
    probes_for,
    rank_matches,
    vector_size,
    with_document_columns,
)


@dataclass
class AnnIndex:
    """An opened index. ``centroids`` are unit vectors in the order of ``cells``."""

    path: str
    vectors: DataFrame
    cells: np.ndarray
    centroids: np.ndarray
    n_probe: int
    n_buckets: int


def mean_centroids(docs: DataFrame, by: str) -> DataFrame:
    """``(cell, centroid)``: the mean vector of every value of ``by``, an integer column."""
    values = docs.where("embedding is not null").select(
        F.col(by).cast("int").alias("cell"), F.posexplode("embedding")
    )
    means = values.groupBy("cell", "pos").agg(F.avg(F.col("col").cast("double")).alias("mean"))
    in_order = F.sort_array(F.collect_list(F.struct("pos", "mean")))
    return means.groupBy("cell").agg(in_order.alias("means")).select(
        "cell", F.col("means.mean").alias("centroid")
    )


def build_ann_index(
    docs: DataFrame,
    path: str,
    centroids: DataFrame,
    n_probe: int | None = None,
    queries: DataFrame | None = None,
    match_count: int = config.MATCH_COUNT,
    threshold: float = config.MATCH_THRESHOLD,
    block_bytes: int = BLOCK_BYTES,
) -> AnnIndex:
    """Write an index of ``docs(id, embedding, ...)`` and open it.

    ``centroids(cell, centroid)`` may come from ``mean_centroids``, from a clustering or from
    anywhere; there are as many as one array holds. Documents go to the most similar cell,
    equally similar ones to the smaller; NULL and zero vectors are in no cell. ``n_probe`` is
    the default number of cells per query. Without it ``queries`` are needed: the least number that
    finds 0.9 of their exact matches is measured (see ``probes_for``), or every cell without any.
    """
    spark = docs.sparkSession
    cells, matrix = _unit_centroids(centroids)
    if not len(cells):
        raise ValueError("an index needs a centroid that is not zero")
    dim = matrix.shape[1]
    rows = max(1, block_bytes // (8 * dim))
    number = F.element_at(F.array(*[F.lit(int(c)) for c in cells]), F.col("_cell") + 1)
    placed = assign_cells(docs, matrix).select("id", "embedding", F.col("cell").alias("_cell"))
    others = [c for c in docs.columns if c not in ("id", "embedding", "cell", "slot")]
    assigned = stored(placed)
    counts = assigned.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).orderBy("_cell").collect()
    first, firsts, parts = 0, [], []
    for row in counts:  # one per cell
        firsts.append(first)
        parts.append(-(-row["n"] // rows))
        first += parts[-1]
    slots = spark.createDataFrame(
        [
            (int(cells[r["_cell"]]), r["_cell"], a, n)
            for r, a, n in zip(counts, firsts, parts, strict=True)
        ],
        "cell int, _cell int, first_slot long, n_slots long",
    )
    part = F.pmod(F.xxhash64("id"), F.col("n_slots"))
    with_slots = (
        assigned.join(F.broadcast(slots.drop("cell")), "_cell")
        .select(number.alias("cell"), "id", "embedding", (F.col("first_slot") + part).alias("slot"))
    )
    if others:
        with_slots = with_slots.join(docs.select("id", *others), "id")
    n_buckets = max(1, min(first, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    (
        with_slots.write.partitionBy("cell")
        .bucketBy(n_buckets, "slot")
        .option("path", f"{path}/vectors")
        .mode("overwrite")
        .saveAsTable(_table_name(path))
    )
    centroids.select(F.col("cell").cast("int"), "centroid").write.mode("overwrite").parquet(
        f"{path}/centroids"
    )
    slots.drop("_cell").coalesce(1).write.mode("overwrite").parquet(f"{path}/slots")
    if n_probe is None:
        n_probe = len(cells)
        if queries is not None:
            n_probe = probes_for(
                assigned.select("id", "embedding", F.col("_cell").alias("cell")),
                queries, matrix, match_count, threshold,
            )
    settings = [(dim, sum(r["n"] for r in counts), n_buckets, int(n_probe))]
    spark.createDataFrame(settings, "dim int, n_rows long, n_buckets int, n_probe int").coalesce(
        1
    ).write.mode("overwrite").parquet(f"{path}/settings")
    return open_ann_index(spark, path)


def open_ann_index(spark: SparkSession, path: str) -> AnnIndex:
    """The index at ``path``, written by this or another application."""
    settings = spark.read.parquet(f"{path}/settings").first()
    cells, matrix = _unit_centroids(spark.read.parquet(f"{path}/centroids"))
    if settings["n_rows"]:
        vectors = spark.read.parquet(f"{path}/vectors")
    else:  # nothing was written that could be read
        vectors = spark.createDataFrame([], "id long, embedding array<double>, slot long, cell int")
    return AnnIndex(path, vectors, cells, matrix, settings["n_probe"], settings["n_buckets"])


def _unit_centroids(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    table = centroids.select(F.col("cell").cast("int"), "centroid").orderBy("cell").toArrow()
    sizes = {len(c) for c in table.column(1).to_pylist() if c is not None}
    if len(sizes) != 1:
        return np.zeros(0, np.int32), np.zeros((0, 0))
    positions, matrix = v.unit_rows(table.column(1), sizes.pop())
    return table.column(0).to_numpy()[positions], matrix


def _table_name(path: str) -> str:
    return f"ann_{hashlib.sha256(path.encode('utf-8')).hexdigest()[:24]}"


def _registered(spark: SparkSession, path: str, n_buckets: int) -> str:
    """The catalog's name of the vectors, which is what tells Spark of the buckets."""
    name = _table_name(path)
    if not spark.catalog.tableExists(name):
        files = spark.read.parquet(f"{path}/vectors")
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY (cell) "
            f"CLUSTERED BY (slot) INTO {n_buckets} BUCKETS LOCATION '{path}/vectors'"
        )
        spark.catalog.recoverPartitions(name)
    return name


def search(
    index: AnnIndex,
    queries: DataFrame,
    match_count: int = config.MATCH_COUNT,
    threshold: float = config.MATCH_THRESHOLD,
    n_probe: int | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The best documents of the ``n_probe`` cells nearest to each query, above ``threshold``.

    Rules and columns as in ``match_documents``; probing every cell is exact search. A query
    with a NULL or zero vector has no match. More queries than ``block_bytes`` hold are taken in
    turns while this is called, and scored in blocks of that size (see ``blocks_in_turn``).
    """
    n_probe = min(n_probe or index.n_probe, len(index.cells))
    dim = index.centroids.shape[1]
    queries = queries.select("query_id", "embedding")
    if vector_size(queries) is None or index.vectors.isEmpty():
        best = index.vectors.where("false").select(
            F.col("id").alias("query_id"), "id", F.lit(0.0).alias("similarity")
        )
        return with_document_columns(rank_matches(best, match_count), index.vectors)
    limit = max(1, block_bytes // (8 * dim))
    head = queries.limit(limit + 1).toArrow()
    if head.num_rows <= limit:
        best = _few(index, head, match_count, threshold, n_probe)
    else:
        best = _many(index, queries, match_count, threshold, n_probe, limit)
    return with_document_columns(rank_matches(best, match_count), index.vectors)


def _few(
    index: AnnIndex, head: pa.Table, k: int, threshold: float, n_probe: int
) -> DataFrame:
    dim = index.centroids.shape[1]
    query_ids, matrix = v.identified(head.column(0), head.column(1), dim)
    probed = v.nearest(matrix, index.centroids, n_probe)
    askers = {
        int(index.cells[c]): np.flatnonzero((probed == c).any(axis=1)) for c in np.unique(probed)
    }
    shared = index.vectors.sparkSession.sparkContext.broadcast((query_ids, matrix, askers))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, matrix, askers = shared.value
        best = v.TopK(query_ids, matrix, k, threshold)
        for batch in batches:
            cells = batch.column(0).to_numpy()
            for cell in np.unique(cells):
                rows = batch.take(pa.array(np.flatnonzero(cells == cell)))
                ids, docs = v.identified(rows.column(1), rows.column(2), dim)
                best.add(ids, docs, askers[int(cell)])
        yield best.result()

    # A filter on the partition column: other cells' files are not opened.
    asked = index.vectors.where(F.col("cell").isin(*askers))
    return asked.select("cell", "id", "embedding").mapInArrow(score, v.MATCH_SCHEMA)


def _many(
    index: AnnIndex, queries: DataFrame, k: int, threshold: float, n_probe: int, limit: int
) -> DataFrame:
    spark, dim = index.vectors.sparkSession, index.centroids.shape[1]
    number = F.element_at(F.array(*[F.lit(int(c)) for c in index.cells]), F.col("cell") + 1)
    # One row per cell of the index.
    slots = F.broadcast(spark.read.parquet(f"{index.path}/slots"))

    def place(asked: DataFrame) -> DataFrame:
        probes = assign_cells(asked, index.centroids, "query_id", n_probe)
        return probes.withColumn("cell", number).join(slots, "cell").select(
            F.explode(F.sequence("first_slot", F.col("first_slot") + F.col("n_slots") - 1)).alias("slot"),
            "query_id", "embedding",
        )

    vectors = spark.table(_registered(spark, index.path, index.n_buckets))
    return blocks_in_turn(vectors, queries, place, dim, k, threshold, limit)
