"""Vector retrieval: exact and approximate cosine top-k, and what follows from matches.

Documents are ``(id, embedding, ...)``, queries ``(query_id, embedding, ...)``, matches
``(query_id, rank, id, ..., similarity)``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow import config
from corpusflow.functions import vectors as v
from corpusflow.functions.lineage import HOT_ROWS, lookup, shared_folder, stored

# Vectors that a broadcast, a slot of documents or a block of queries may hold.
BLOCK_BYTES = 16 * 1024 * 1024
# Vectors of queries that go to the slots in one job; a task scores them in blocks.
TURN_BYTES = 32 * 1024 * 1024
# Queries that a task makes into unit vectors and scores at once, at most.
_BLOCK_ROWS = 4096
# Slots of fewer documents are not worth a task of their own.
_SLOT_ROWS = 4096
# Share of the exact matches an approximate search is to find, and the queries it is measured by.
TARGET_RECALL = 0.9
RECALL_QUERIES = 256
# Winners that are broadcast to fetch their text.
_BROADCAST_ROWS = 500_000
_DOC_COLUMNS = ("content", "source_url", "title", "section")


def match_documents(
    docs: DataFrame,
    queries: DataFrame,
    match_count: int = config.MATCH_COUNT,
    threshold: float = config.MATCH_THRESHOLD,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The ``match_count`` documents most similar to each query, above ``threshold``.

    Similarity is one minus cosine distance and must be strictly greater than the
    threshold; ties go to the smaller id. A NULL or zero vector never matches.

    Queries that fit in ``block_bytes`` (checked by fetching at most one row more) are
    broadcast and the documents are scored where they are read, without a shuffle. For more
    queries than that the vectors are written once, bucketed by bounded slots and without a
    shuffle, and the queries come to them, ``TURN_BYTES`` in a job (jobs run while this is called)
    and scored in blocks of ``block_bytes``. Either way only ``match_count`` rows per query and
    task leave Python.
    """
    dim, n_queries = vector_size(queries), None
    if dim is None:
        best = _no_matches(docs)
    else:
        limit = max(1, block_bytes // (8 * dim))
        head = queries.select("query_id", "embedding").limit(limit + 1).toArrow()
        if head.num_rows <= limit:
            n_queries = head.num_rows
            best = _broadcast_top_k(docs, head, dim, match_count, threshold)
        else:
            slots, n_slots = _in_slots(docs, limit)
            every_slot = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_slots - 1).cast("long")))

            def in_every_slot(asked: DataFrame) -> DataFrame:
                return asked.select(every_slot.alias("slot"), "query_id", "embedding")

            best = blocks_in_turn(slots, queries, in_every_slot, dim, match_count, threshold, limit)
    ranked = rank_matches(best, match_count)
    if n_queries is not None and n_queries * match_count <= _BROADCAST_ROWS:
        ranked = F.broadcast(ranked)
    return with_document_columns(ranked, docs)


def vector_size(df: DataFrame) -> int | None:
    """Dimension of the vectors, read from one row."""
    row = df.where("embedding is not null").select(F.size("embedding").alias("n")).first()
    return None if row is None else row.n


def _no_matches(docs: DataFrame) -> DataFrame:
    return docs.where("false").select(
        F.col("id").alias("query_id"), "id", F.lit(0.0).alias("similarity")
    )


def rank_matches(scored: DataFrame, match_count: int) -> DataFrame:
    """Final top-k of the per-task candidates."""
    best_first = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return scored.withColumn("rank", F.row_number().over(best_first)).where(
        F.col("rank") <= match_count
    )


def with_document_columns(matches: DataFrame, docs: DataFrame) -> DataFrame:
    """Fetch the text columns for the winners only."""
    columns = [name for name in _DOC_COLUMNS if name in docs.columns]
    if not columns:
        return matches.select("query_id", "rank", "id", "similarity")
    return matches.join(docs.select("id", *columns), "id").select(
        "query_id", "rank", "id", *columns, "similarity"
    )


def _broadcast_top_k(
    docs: DataFrame, queries: pa.Table, dim: int, k: int, threshold: float
) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(
        v.identified(queries.column(0), queries.column(1), dim)
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, matrix = shared.value
        return v.score_batches(batches, query_ids, matrix, k, threshold)

    return docs.select("id", "embedding").mapInArrow(score, v.MATCH_SCHEMA)


def _in_slots(docs: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """``(slot, id, embedding)``, at most about ``rows`` vectors a slot, bucketed by slot; how many slots."""
    spark = docs.sparkSession
    n_rows = docs.count()
    # Two slots per core where there are vectors enough for it.
    spread = min(2 * spark.sparkContext.defaultParallelism, n_rows // _SLOT_ROWS)
    n_slots = max(1, -(-n_rows // rows), spread)
    name = f"vectors_{uuid.uuid4().hex}"
    buckets = max(1, min(n_slots, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    (
        docs.select(F.pmod(F.xxhash64("id"), F.lit(n_slots)).alias("slot"), "id", "embedding")
        .write.bucketBy(buckets, "slot")
        .option("path", f"{shared_folder(spark)}/{name}")
        .saveAsTable(name)
    )
    return spark.table(name), n_slots


def blocks_in_turn(
    vectors: DataFrame,
    queries: DataFrame,
    place: Callable[[DataFrame], DataFrame],
    dim: int,
    k: int,
    threshold: float,
    limit: int,
) -> DataFrame:
    """Top-k of ``queries(query_id, embedding)`` against ``vectors(slot, id, embedding)``.

    ``vectors`` is a table bucketed by slot: it is read where it lies, and ``place`` sends queries to
    their slots as ``(slot, query_id, embedding)``. A job takes ``TURN_BYTES`` of queries whatever
    ``limit`` is, so the vectors are read once per so many queries; a task holds a slot and a
    job's queries, and scores ``limit`` of them at a time.
    """
    by_slot = vectors.select("slot", "id", "embedding").groupBy("slot")
    score = _scored_in_blocks("embedding", dim, k, threshold, limit)
    n_turns = -(-queries.count() // max(limit, TURN_BYTES // (8 * dim)))
    turn = F.pmod(F.xxhash64("query_id"), F.lit(n_turns))
    parts = []
    for number in range(n_turns):
        asked = place(queries.where(turn == number)).groupBy("slot")
        found = by_slot.cogroup(asked).applyInArrow(score, v.MATCH_SCHEMA)
        parts.append(stored(rank_matches(found, k).select("query_id", "id", "similarity")))
    return reduce(DataFrame.unionByName, parts)


def _scored_in_blocks(
    vector: str, dim: int, k: int, threshold: float, limit: int
) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Top-k of a group's queries, ``limit`` or fewer at a time, among its documents."""
    limit = min(limit, _BLOCK_ROWS)

    def score(docs: pa.Table, asked: pa.Table) -> pa.Table:
        held = v.identified(docs.column("id"), docs.column("embedding"), dim) if docs.num_rows else None
        found = []
        for low in range(0, max(1, asked.num_rows), limit):
            block = asked.slice(low, limit)
            best = v.TopK(*v.identified(block.column("query_id"), block.column(vector), dim), k, threshold)
            if held is not None:
                best.add(*held)
            found.append(best.result())
        return pa.Table.from_batches(found)

    return score


def _grid_top_k(
    docs: DataFrame,
    queries: DataFrame,
    dim: int,
    k: int,
    threshold: float,
    block_bytes: int,
) -> DataFrame:
    """Score every (document, query) pair of a cell in blocks of bounded size.

    A cell with many documents is split into document shards and one with many queries
    into query blocks; each document goes to its shard for every query block and each
    query to its block for every shard. No task holds more than one block of each side,
    however full a cell is.
    """
    rows = max(1, block_bytes // (8 * dim))

    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(rows)).alias(name))

    # One row per cell; the number of cells is a parameter of the index.
    grid = F.broadcast(blocks(docs, "n_shards").join(blocks(queries, "n_blocks"), "cell"))

    def own(id_column: str, n: str) -> Column:
        return F.pmod(F.xxhash64(id_column), F.col(n))

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    placed_docs = docs.join(grid, "cell").select(
        "cell", own("id", "n_shards").alias("shard"), every("n_blocks").alias("block"),
        "id", "embedding",
    )
    placed_queries = queries.join(grid, "cell").select(
        "cell", every("n_shards").alias("shard"), own("query_id", "n_blocks").alias("block"),
        "query_id", F.col("embedding").alias("query_embedding"),
    )

    score = _scored_in_blocks("query_embedding", dim, k, threshold, rows)
    key = ("cell", "shard", "block")
    return (
        placed_docs.groupBy(*key)
        .cogroup(placed_queries.groupBy(*key))
        .applyInArrow(score, v.MATCH_SCHEMA)
    )


# -- approximate search ----------------------------------------------------------------


def train_centroids(
    docs: DataFrame, n_lists: int, sample_rows: int | None = None, seed: int = 7
) -> np.ndarray:
    """Unit centroids of an inverted-file index, trained on a hash-ordered sample.

    Only the centroids come from the sample; every document is indexed.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    sample = (
        docs.where(F.exists("embedding", lambda x: x != 0))
        .orderBy(F.xxhash64("id"))
        .limit(sample_rows or 50 * n_lists)
        .select(array_to_vector("embedding").alias("features"))
    )
    model = KMeans(
        k=n_lists, seed=seed, maxIter=10, distanceMeasure="cosine", initSteps=2
    ).fit(sample)
    centroids = np.vstack(model.clusterCenters())
    return centroids / np.linalg.norm(centroids, axis=1, keepdims=True)


def assign_cells(
    df: DataFrame, centroids: np.ndarray, id_column: str = "id", n_cells: int = 1
) -> DataFrame:
    """``(cell, id, embedding)`` for the ``n_cells`` nearest cells of every vector."""
    shared = df.sparkSession.sparkContext.broadcast(centroids)
    vector_type = df.schema["embedding"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            positions, matrix = v.unit_rows(batch.column(1), shared.value.shape[1])
            if not len(positions):
                continue
            cells = v.nearest(matrix, shared.value, n_cells)
            rows = batch.take(pa.array(np.repeat(positions, cells.shape[1])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells.ravel().astype(np.int32)), rows.column(0), rows.column(1)],
                names=["cell", id_column, "embedding"],
            )

    return df.select(id_column, "embedding").mapInArrow(
        assign, f"cell int, {id_column} bigint, embedding {vector_type}"
    )


def probes_for(
    docs: DataFrame,
    queries: DataFrame,
    centroids: np.ndarray,
    match_count: int = config.MATCH_COUNT,
    threshold: float = config.MATCH_THRESHOLD,
    target: float = TARGET_RECALL,
    sample_queries: int = RECALL_QUERIES,
) -> int:
    """Least number of probes with which an index finds ``target`` of the exact matches.

    Measured against the exact search for at most ``sample_queries`` queries, in hash
    order: both the share of all their matches and the mean over queries, less two standard
    errors, reach the target. Without a match to measure by, every cell is probed. Choose
    once per index.
    """
    n_lists = len(centroids)
    sample = (
        queries.where(F.exists("embedding", lambda x: x != 0))
        .orderBy(F.xxhash64("query_id"))
        .limit(sample_queries)
        .select("query_id", "embedding")
    )
    head = sample.toArrow()
    if not head.num_rows:
        return n_lists
    exact = match_documents(docs.select("id", "embedding"), sample, match_count, threshold)
    cells = docs if "cell" in docs.columns else assign_cells(docs, centroids)
    # At most ``sample_queries`` * ``match_count`` rows.
    found = (
        exact.select("query_id", "id").join(cells.select("id", "cell"), "id").toPandas()
    )
    if not len(found):
        return n_lists
    query_ids, matrix = v.identified(head.column(0), head.column(1), centroids.shape[1])
    ranks = np.argsort(v.nearest(matrix, centroids, n_lists), axis=1)
    place = {int(q): n for n, q in enumerate(query_ids)}
    rows = found["query_id"].map(place).to_numpy()
    rank = ranks[rows, found["cell"].to_numpy()]
    of_query = np.bincount(rows, minlength=len(query_ids))
    counted = of_query > 0
    for n_probe in range(1, n_lists):
        hits = rank < n_probe
        each = (np.bincount(rows[hits], minlength=len(query_ids))[counted]) / of_query[counted]
        error = each.std() / np.sqrt(len(each))
        if min(each.mean(), hits.mean()) - 2 * error >= target:
            return n_probe
    return n_lists


def approx_match_documents(
    docs: DataFrame,
    queries: DataFrame,
    centroids: np.ndarray,
    n_probe: int = 8,
    match_count: int = config.MATCH_COUNT,
    threshold: float = config.MATCH_THRESHOLD,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Inverted-file search: only the ``n_probe`` cells nearest to a query are scored.

    ``probes_for`` gives the number of probes that an index needs for a target recall.

    Documents may come with a stored ``cell`` column (see ``assign_cells``); otherwise
    they are assigned here. Crowded cells are split into bounded shards.
    """
    dim = centroids.shape[1]
    indexed = (
        docs.select("cell", "id", "embedding")
        if "cell" in docs.columns
        else assign_cells(docs, centroids)
    )
    probes = assign_cells(queries, centroids, "query_id", n_probe)
    best = _grid_top_k(indexed, probes, dim, match_count, threshold, block_bytes)
    return with_document_columns(rank_matches(best, match_count), docs)


def recall(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """Per query: exact matches, how many of them the approximate search found."""
    found = approximate.select("query_id", "id", F.lit(1).alias("found"))
    return (
        exact.select("query_id", "id")
        .join(found, ["query_id", "id"], "left")
        .groupBy("query_id")
        .agg(
            F.count(F.lit(1)).alias("n_exact"),
            F.count("found").alias("n_found"),
            (F.count("found") / F.count(F.lit(1))).alias("recall"),
        )
    )


# -- after the search ------------------------------------------------------------------


def unanswered(
    queries: DataFrame, matches: DataFrame, answer: str = config.NO_MATCH_ANSWER
) -> DataFrame:
    """Queries without a match, with the fixed answer they get."""
    return queries.join(matches.select("query_id").distinct(), "query_id", "left_anti").withColumn(
        "answer", F.lit(answer)
    )


def pick_source(matches: DataFrame, homepage_urls: tuple[str, ...] = ()) -> DataFrame:
    """The one source to show per query: ``(query_id, url, title, content)``.

    Rows are grouped by URL; specific pages beat homepages. Among the URLs whose best
    similarity is within 0.05 of the group's best, the one with most rows wins, then the
    more similar, then the better ranked. (A pairwise rule "more than 0.05 apart: by
    similarity, else by count" is not transitive; the two agree except in chains of near
    ties.) If no row has a URL the first match is used.
    """
    no_url = F.col("_url") == ""
    by_url = (
        matches.withColumn("_url", F.coalesce("source_url", F.lit("")))
        .groupBy("query_id", "_url", F.when(no_url, F.col("rank")).alias("_alone"))
        .agg(
            F.max(F.coalesce("similarity", F.lit(0.0))).alias("similarity"),
            F.count(F.lit(1)).alias("n"),
            F.min("rank").alias("rank"),
            F.max_by(
                F.struct("title", F.coalesce("content", F.lit("")).alias("content")),
                F.struct(F.length(F.coalesce("content", F.lit(""))), -F.col("rank")),
            ).alias("best"),
        )
        .withColumn(
            "_class",
            F.when(no_url, 2).when(F.col("_url").isin(*homepage_urls), 1).otherwise(0),
        )
    )
    in_class = Window.partitionBy("query_id", "_class")
    close = F.col("similarity") >= F.max("similarity").over(in_class) - F.lit(
        config.SOURCE_SIMILARITY_BAND
    )
    url_order = Window.partitionBy("query_id").orderBy(
        "_class",
        F.when(no_url, F.col("rank")),
        F.desc("_close"),
        F.desc("n"),
        F.desc("similarity"),
        "rank",
    )
    return (
        by_url.withColumn("_close", close)
        .withColumn("_order", F.row_number().over(url_order))
        .where("_order = 1")
        .select(
            "query_id",
            F.col("_url").alias("url"),
            F.nullif(F.col("best.title"), F.lit("")).alias("title"),
            F.col("best.content").alias("content"),
        )
    )


def cache_lookup(queries: DataFrame, cache: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``answer`` from ``cache(question, answer)`` by exact text; NULL is a miss.

    The cache has one row per question. Questions asked very often are answered without
    a shuffle (see ``lookup``).
    """
    return lookup(queries, cache.select("question", "answer"), "question", hot_rows=hot_rows)


def cache_misses(queries: DataFrame, cache: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Queries the answer cache does not hold."""
    held = cache.select("question", F.lit(True).alias("_held"))
    found = lookup(queries, held, "question", hot_rows=hot_rows)
    return found.where(F.col("_held").isNull()).select(*queries.columns)
