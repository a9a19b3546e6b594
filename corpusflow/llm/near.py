"""Near duplicates by circulant MinHash, banding and exact Jaccard verification.

1. A text's set is its distinct word shingles. Its signature comes from two permutations: the
   first scatters shingles over ``PLACES`` places, the second numbers the places, and the k-th
   coordinate is the least number after shifting the second by k places, circularly. Bands of
   coordinates are hashed to buckets.
2. Texts with equal sets are one node from here on. Every member of a bucket is tied to the
   bucket's smallest node, which needs no pairs, and the components of these ties are the
   families in which links may be.
3. Sets travel once to their family. Within a family, links are confirmed on full sets: a
   prefix filter over the family's rare shingles and a bound by shingles that nobody shares
   leave few pairs, and nodes that are linked already are not compared again. In a family beyond
   ``BLOCK`` shingles all nodes are first compared with a few of them. Those linked with the one
   that has most links, its hub, are one group already and need no pairs among each other; blocks
   of the others meet each other and the blocks of that group, a pair of blocks per task.
4. Components of the confirmed links are the groups.

``kept`` is true for the smallest id of a group. A null or empty text has an empty set and is
linked with nothing. A row with a null id is linked with nothing, kept, and has a null group.
Each row is judged by its own text; rows that repeat an id and a text get the same values.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField

from corpusflow.functions.lineage import shared_folder
from corpusflow.llm.bpe import CACHED_HASHES, Generations
from corpusflow.llm.components import components
from corpusflow.llm.frames import append_columns, fresh, list_array, texts_of, without

COORDINATES = 320
PLACES = 1 << 20
MISSED = 1e-5  # highest chance that a pair at the threshold shares no bucket
BLOCK = 100_000  # shingles of a family in one block; a node counts as NODE more
NODE = 200
HUBS = 4  # nodes of a large family that all others are compared with first
SEED = 20


def bands_for(percent: int, coordinates: int = COORDINATES) -> tuple[int, int]:
    """Rows per band and bands: the longest rows that miss a pair at the threshold rarely."""
    similarity = percent / 100
    for rows in range(coordinates, 0, -1):
        bands = coordinates // rows
        if (1 - similarity**rows) ** bands <= MISSED:
            return rows, bands
    return 1, coordinates


@lru_cache(maxsize=1)
def _word_hashes() -> Generations:
    return Generations(xxhash.xxh3_64_intdigest, CACHED_HASHES)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of ``width`` words.

    Words are runs without blanks, tabs and line ends; only A to Z change case. A text with
    fewer words is one shingle.
    """
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_word_hashes().__getitem__, words), np.uint64, len(words))
    count = min(width, len(words))
    total = np.full(len(words) - count + 1, count, np.uint64)
    for k in range(count):
        total = _mixed(total + hashes[k : len(hashes) - count + 1 + k])
    return np.unique(total)


@lru_cache(maxsize=1)
def _numbered_places() -> np.ndarray:
    """Rows of consecutive numbers of places: row p holds the numbers of p, p+1, ... ."""
    numbers = np.random.default_rng(SEED).permutation(PLACES).astype(np.uint32)
    circle = np.concatenate([numbers, numbers[: COORDINATES - 1]])
    return np.lib.stride_tricks.sliding_window_view(circle, COORDINATES)


def signature(values: np.ndarray) -> np.ndarray:
    """All coordinates of a set: minima over its places' runs of numbers."""
    places = (_mixed(values + np.uint64(SEED)) >> np.uint64(44)).astype(np.int64)
    rows = _numbered_places()
    least = np.full(COORDINATES, PLACES, np.uint32)
    for start in range(0, len(places), 1024):
        np.minimum(least, rows[places[start : start + 1024]].min(axis=0), out=least)
    return least


def buckets(values: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """One 64-bit key per band."""
    parts = signature(values)[: rows * bands].reshape(bands, rows).astype(np.uint64)
    keys = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        keys = _mixed(keys + parts[:, k])
    return keys


def with_sets(docs: DataFrame, text: str, width: int, percent: int) -> DataFrame:
    """Replaces ``text`` by ``n_shingles``, ``_set`` (digest) and ``_buckets``."""
    rows, bands = bands_for(percent)

    def compute():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            counts, digests, keys = [], [], []
            for value in texts_of(batch, text):
                values = shingles(value, width)
                counts.append(len(values))
                if len(values):
                    digests.append(hashlib.blake2b(values.tobytes(), digest_size=16).hexdigest())
                    keys.append(buckets(values, rows, bands).tobytes())
                else:
                    digests.append(None)
                    keys.append(b"")
            return [
                pa.array(counts, pa.int64()),
                pa.array(digests, pa.string()),
                list_array(b"".join(keys), [len(k) // 8 for k in keys], pa.int64()),
            ]

        return work

    fields = [
        StructField("n_shingles", LongType()),
        StructField("_set", StringType()),
        StructField("_buckets", ArrayType(LongType())),
    ]
    return append_columns(docs, fields, compute, drop=(text,))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def linked(
    sets: list[np.ndarray], percent: int, joined: list[bool] | None = None
) -> list[tuple[int, int]]:
    """Links that span the groups of ``sets`` (sorted, distinct values), as pairs of places.

    Exact: every two sets with ``100 * common >= percent * union`` end up connected, and only
    such pairs are returned. Those that are ``joined`` count as connected from the start.
    """
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    lengths = np.array([len(sets[i]) for i in order])
    _, inverse, counts = np.unique(
        np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True
    )
    rank = np.empty(len(counts), np.int64)  # rare values first
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    alone = np.count_nonzero(counts == 1)
    flat, ends = rank[inverse], np.cumsum(lengths)
    values = [np.sort(flat[e - n : e]) for e, n in zip(ends, lengths, strict=True)]
    shared = np.array([n - np.searchsorted(v, alone) for n, v in zip(lengths, values, strict=True)])
    label = np.arange(len(order))
    members = {i: [i] for i in range(len(order))}
    if joined is not None and any(joined):
        together = [x for x, i in enumerate(order) if joined[i]]
        label[together] = together[0]
        members[together[0]] = together
    degree = np.zeros(len(order), np.int64)
    postings: dict[int, list[int]] = {}
    found = []
    for x, (n, own) in enumerate(zip(lengths, values, strict=True)):
        prefix = own[: n - -(-n * percent // 100) + 1]
        prefix = prefix[prefix >= alone].tolist()
        lists = [postings[p] for p in prefix if p in postings]
        if lists:
            near = np.unique(np.concatenate(lists))
            most = np.minimum(shared[near], shared[x])
            near = near[100 * most >= percent * (lengths[near] + n - most)]
            for y in near[np.argsort(-degree[near], kind="stable")].tolist():
                if label[y] == label[x]:
                    continue
                if similar(own, values[y], percent):
                    found.append((order[x], order[y]))
                    degree[y] += 1
                    degree[x] += 1
                    small, large = sorted((label[x], label[y]), key=lambda k: len(members[k]))
                    label[members[small]] = large
                    members[large] += members.pop(small)
        for p in prefix:
            postings.setdefault(p, []).append(x)
    return found


def near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 3, percent: int = 85
) -> DataFrame:
    """``docs`` with ``n_shingles``, ``component_id`` and ``kept``.

    Two texts are linked if ``100 * common >= percent * union`` of their shingles of ``width``
    words. ``component_id`` is the smallest id that can be reached over links. Runs jobs while
    it is called, for the iterations; intermediate tables are narrow and lie in the session's
    shared checkpoint folder.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/near-{uuid.uuid4().hex}"

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    key = F.col(doc_id).cast("long")
    narrow = docs.select(key.alias("_id"), F.col(text).alias("_text"))
    sets = stored(with_sets(narrow, "_text", width, percent), "sets")
    usable = sets.where(F.col("_set").isNotNull() & F.col("_id").isNotNull())
    nodes = stored(
        usable.groupBy("_set").agg(
            F.min("_id").alias("node"),
            F.first("n_shingles").alias("n"),
            F.first("_buckets").alias("_buckets"),
        ),
        "nodes",
    )
    placed = nodes.select("node", F.explode("_buckets").alias("bucket"))
    firsts = stored(
        placed.groupBy("bucket")
        .agg(F.min("node").alias("first"), F.max("node").alias("last"))
        .where("first != last")
        .select("bucket", "first"),
        "firsts",
    )
    ties = placed.join(firsts, "bucket").select("node", "first").where("node != first").distinct()
    families = components(ties, "node", "first").withColumnRenamed("component", "family")
    families = families.join(nodes.select("node", "n", "_set"), "node")
    blocks = families.groupBy("family").agg(
        F.ceil(F.sum(F.col("n") + NODE) / BLOCK).cast("int").alias("blocks")
    )
    families = stored(families.join(blocks, "family"), "families")

    # The text of one row per set: the node's own.
    members = with_values(
        narrow.join(
            families.select(F.col("node").alias("_id"), "family", "blocks", "_set").hint("merge"),
            "_id",
        ),
        width,
    ).select("family", "blocks", F.col("_id").alias("node"), "_set", "_values")
    some_large = not families.where("blocks > 1").isEmpty()
    if some_large:  # read more than once; otherwise the sets go straight to their family
        members = stored(members, "members")
    confirmed = _links(
        members.where("blocks = 1").select("family", "node", "_values"), ["family"], percent
    )
    if some_large:
        large = members.where("blocks > 1")
        by_hub, of_hub = _hubs(large, percent, stored)
        task = ["family", "with_group", "i", "j"]
        # Dealt by task: after joins by family the tasks of one would otherwise stay together.
        others = _links(_sent(large, of_hub).repartition(*task), task, percent)
        confirmed = confirmed.unionByName(by_hub).unionByName(others)
    groups = components(confirmed).withColumnRenamed("component", "_component")
    found = stored(
        nodes.select("_set", "node").join(groups, "node", "left").select(
            "_set", F.coalesce("_component", "node").alias("component_id")
        ),
        "found",
    )
    result = sets.drop("_buckets").join(found, "_set", "left")
    return _with_result(docs, result, text, doc_id)


def _links(members: DataFrame, task: list[str], percent: int) -> DataFrame:
    """Links within each task of ``members(..., node, _values[, joined])``."""

    def links(group: pa.Table) -> pa.Table:
        ids = group.column("node").to_pylist()
        arrays = [np.frombuffer(v, np.uint64) for v in group.column("_values").to_pylist()]
        joined = group.column("joined").to_pylist() if "joined" in group.column_names else None
        pairs = linked(arrays, percent, joined)
        return pa.table(
            {
                "a": pa.array([ids[x] for x, _ in pairs], pa.int64()),
                "b": pa.array([ids[y] for _, y in pairs], pa.int64()),
            }
        )

    return members.groupBy(*task).applyInArrow(links, "a long, b long")


def _hubs(large: DataFrame, percent: int, stored: Callable) -> tuple[DataFrame, DataFrame]:
    """Links of all nodes with a few of their family, and the nodes that the best of these links.

    The few go to every part of their family, so no task holds more than a part and those few.
    """
    draw = Window.partitionBy("family").orderBy(F.xxhash64("_set"), "node")
    narrow = large.select("family", "blocks", "node", "_set")
    chosen = narrow.withColumn("n", F.row_number().over(draw)).where(F.col("n") <= HUBS)
    own_part = F.pmod(F.xxhash64("_set"), F.col("blocks")).cast("int")
    parts = large.select("family", own_part.alias("part"), "node", "_values")
    # Stored under names of their own: both sides come from one table.
    hubs = stored(
        large.join(chosen.select("node"), "node", "left_semi").select(
            F.col("family").alias("hub_family"),
            F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("hub_part"),
            F.col("node").alias("hub"),
            F.col("_values").alias("hub_values"),
        ),
        "chosen",
    )

    def compare(own: pa.Table, few: pa.Table) -> pa.Table:
        hubs = [
            (r["hub"], np.frombuffer(r["hub_values"], np.uint64))
            for r in few.select(["hub", "hub_values"]).to_pylist()
        ]
        found = []
        for node, values in zip(own.column("node").to_pylist(), own.column("_values").to_pylist(), strict=True):
            values = np.frombuffer(values, np.uint64)
            found += [(own.column("family")[0].as_py(), h, node) for h, v in hubs if similar(v, values, percent)]
        columns = list(zip(*found, strict=True)) or [()] * 3
        return pa.table(
            {n: pa.array(c, pa.int64()) for n, c in zip(("family", "hub", "node"), columns, strict=True)}
        )

    found = stored(
        parts.groupBy("family", "part")
        .cogroup(hubs.groupBy("hub_family", "hub_part"))
        .applyInArrow(compare, "family long, hub long, node long"),
        "hubs",
    )
    counts = found.groupBy("family", "hub").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("family").agg(
        F.max_by("hub", F.struct("n", (-F.col("hub")).alias("first"))).alias("hub")
    )
    of_hub = stored(found.join(best, ["family", "hub"]).select("node"), "of_hub")
    return found.select(F.col("hub").alias("a"), F.col("node").alias("b")), of_hub


def _sent(large: DataFrame, of_hub: DataFrame) -> DataFrame:
    """Sets by task: those without a link to their family's hub meet each other and its group.

    A set of the group is sent once per block of the others, of which there are few where a family
    is made of copies; where there are none, nothing is sent.
    """
    marked = large.join(
        of_hub.select("node", F.lit(True).alias("joined")).hint("merge"), "node", "left"
    ).withColumn("joined", F.coalesce("joined", F.lit(False)))
    weight = F.octet_length("_values") / 8 + NODE

    def blocks(of: Column) -> Column:
        return F.ceil(F.coalesce(F.sum(F.when(of, weight)), F.lit(0)) / BLOCK).cast("int")

    counts = marked.groupBy("family").agg(
        blocks(~F.col("joined")).alias("others"), blocks(F.col("joined")).alias("grouped")
    ).where("others > 0")
    placed = marked.join(counts, "family").withColumn(
        "block",
        F.pmod(F.xxhash64("_set"), F.when(F.col("joined"), F.col("grouped")).otherwise(F.col("others"))).cast("int"),
    )

    def task(with_group: bool, i: Column, j: Column) -> Column:
        return F.struct(F.lit(with_group).alias("with_group"), i.alias("i"), j.alias("j"))

    def numbers(n: str) -> Column:
        return F.sequence(F.lit(0), F.col(n) - 1)

    block = F.col("block")
    to_group = F.transform(numbers("grouped"), lambda j: task(True, block, j))
    # Two blocks of others in a task see the pairs within each as well.
    to_others = F.transform(
        F.filter(numbers("others"), lambda k: (k != block) | (F.col("others") == 1)),
        lambda k: task(False, F.least(k, block), F.greatest(k, block)),
    )
    from_others = F.transform(numbers("others"), lambda i: task(True, i, block))
    tasks = F.when(F.col("joined"), from_others).otherwise(F.concat(to_group, to_others))
    sent = placed.select("family", "node", "_values", "joined", F.explode(tasks).alias("task"))
    return sent.select("family", "task.*", "node", "_values", "joined")


def _with_result(docs: DataFrame, result: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Narrow results put beside the rows of ``docs``: by id, where ``docs`` has more columns."""
    component = F.when(F.col("_id").isNotNull(), F.coalesce("component_id", "_id"))
    rows = result.select(
        "_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"),
    )
    if {c.lower() for c in docs.columns} <= {text.lower(), doc_id.lower()}:
        return rows.withColumnRenamed("_id", doc_id)
    rows = rows.groupBy("_id").agg(
        F.max("n_shingles").alias("n_shingles"),
        F.min("component_id").alias("component_id"),
        F.max("kept").alias("kept"),
    )
    kept = docs.select(*without(docs, ["n_shingles", "component_id", "kept"]))
    [key] = fresh(docs, "id")
    rows = rows.withColumnRenamed("_id", key)
    return kept.join(rows, F.col(doc_id).cast("long").eqNullSafe(F.col(key))).drop(key)


def with_values(docs: DataFrame, width: int) -> DataFrame:
    """Replaces ``_text`` by ``_values``, the packed set of its shingles."""
    def compute():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            rows = [shingles(value, width).tobytes() for value in texts_of(batch, "_text")]
            return [pa.array(rows, pa.binary())]

        return work

    return append_columns(
        docs, [StructField("_values", BinaryType())], compute, drop=("_text",)
    )

