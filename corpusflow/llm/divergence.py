"""How far sources of a language use its words differently: a sparse merge per pair of groups.

A group is a language and a source. Terms are runs of letters (any code point from 128 on counts
as one), A-Z made small. A language keeps the terms of at least ``min_docs`` of its documents.
A group and a language give every kept term a price ``p = 1 + floor(10^9 * (count + 1) / (N + V))``,
N the occurrences of kept terms there and V the number of kept terms. Group a departs from b by the sum
of ``floor((p - q)^2 / q)`` over all kept terms, p of a and q of b.

Terms of a language are dealt to shards by hash, so that no group's terms meet in one task. Within
a shard a group is a sorted array of term ids with their prices. A task takes the groups of two
blocks (``BLOCK`` groups each) in one shard, and each unordered pair of groups once: a galloping
intersection finds the terms of both; terms of one side and terms of none are priced with the
other side's price of an absent term. Sums over shards are exact integers.

Null texts, languages and sources count as empty strings; each row is a document of its own, repeated
ones too. A group without kept terms is still there, also a language with none (all values 0).
Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions.lineage import stored

# Fixed value: bytes of a term, after A-Z became small. Bytes from 128 on are whole code points.
TERM = re.compile(rb"[a-z\x80-\xff]+")
SCALE = 1_000_000_000
# Entries counted together in a task before they are sent on.
HELD = 200_000
# Terms of a shard, on average, and groups of a block.
SHARD_TERMS, BLOCK = 16_384, 32
# Keys of a step of the intersection that are searched for together.
STRIDE = 256


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents by language, source and term, as far as they fit.

    A row with the empty term says that the group is there.
    """
    names = ["lang", "source", "term", "n", "docs"]
    held: dict[tuple, tuple[Counter, Counter]] = {}
    size = 0

    def flushed() -> pa.RecordBatch:
        langs, sources, terms, ns, docs = [], [], [], [], []
        for (lang, source), (seen, within) in held.items():
            langs += [lang] * (1 + len(seen))
            sources += [source] * (1 + len(seen))
            terms += [b"", *seen]
            ns += [0, *seen.values()]
            docs += [0, *map(within.__getitem__, seen)]
        columns = [
            pa.array(langs, pa.string()),
            pa.array(sources, pa.string()),
            pa.array(terms, pa.binary()).cast(pa.string()),
            pa.array(ns, pa.int64()),
            pa.array(docs, pa.int64()),
        ]
        held.clear()
        return pa.RecordBatch.from_arrays(columns, names)

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(3)]
        for text, *group in zip(*columns, strict=True):
            found = held.get(key := tuple(group))
            if found is None:
                found = held[key] = (Counter(), Counter())
                size += 1
            seen, within = found
            before = len(seen)
            terms = TERM.findall(text.encode("utf-8").lower())
            seen.update(terms)
            within.update(set(terms))
            size += len(seen) - before
            if size >= HELD:
                yield flushed()
                size = 0
    if held:
        yield flushed()


def price(count: Column, n: Column, v: Column) -> Column:
    """``1 + floor(10^9 * (count + 1) / (n + v))``, exact beyond 64 bits.

    Without a kept term (n and v are 0) there is nothing to price; any value will do.
    """
    wide = (count + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    by = F.greatest(n + v, F.lit(1)).cast("decimal(20,0)")
    return 1 + F.call_function("div", wide, by)


def departure(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def term_counts(
    docs: DataFrame, text: str, lang: str, source: str, min_docs: int
) -> tuple[DataFrame, DataFrame]:
    """Counts of kept terms by group, with those of the language, and all groups with N and V."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (text, lang, source)])
    counted = (
        rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )
    along = Window.partitionBy("lang", "term")
    kept = stored(
        counted.select(
            "*",
            F.sum("docs").over(along).alias("lang_docs"),
            F.sum("n").over(along).alias("lang_n"),
            # Counts a kept term of the language once.
            (F.min("source").over(along) == F.col("source")).cast("long").alias("first"),
        )
        .where((F.col("term") == "") | (F.col("lang_docs") >= min_docs))
        .drop("docs", "lang_docs")
    )
    terms = kept.where(F.col("term") != "")
    langs = kept.groupBy("lang").agg(
        F.sum(F.when(F.col("term") != "", F.col("first")).otherwise(0)).alias("v"),
        F.sum("n").alias("n_lang"),
    )
    # The rows of the empty term make every group come up, with a count of 0.
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_group")).join(langs, "lang")
    return terms, groups


def pair_departures(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``item`` (another source) and ``value`` for every ordered pair."""
    by_lang = Window.partitionBy("lang")
    numbered = groups.select(
        "*",
        (F.row_number().over(by_lang.orderBy("source")) - 1).alias("g"),
        F.count(F.lit(1)).over(by_lang).alias("n_groups"),
        F.greatest(F.ceil(F.col("v") / SHARD_TERMS), F.lit(1)).cast("int").alias("shards"),
        price(F.lit(0), F.col("n_group"), F.col("v")).alias("absent"),
    ).withColumn("blocks", F.ceil(F.col("n_groups") / BLOCK).cast("int"))
    numbered = stored(numbered)
    in_shard = Window.partitionBy("lang", "shard")
    priced = terms.join(
        numbered.select("lang", "source", "g", "n_group", "v", "shards"), ["lang", "source"]
    ).select(
        "lang",
        "g",
        F.pmod(F.xxhash64("term"), F.col("shards").cast("long")).cast("int").alias("shard"),
        "term",
        "first",
        price(F.col("n"), F.col("n_group"), F.col("v")).alias("p"),
    )
    with_ids = priced.withColumn(
        "id", (F.dense_rank().over(in_shard.orderBy("term")) - 1).cast("int")
    ).withColumn("n_terms", F.sum("first").over(in_shard))
    arrays = with_ids.groupBy("lang", "shard", "g").agg(
        F.max("n_terms").alias("n_terms"),
        F.sort_array(F.collect_list(F.struct("id", "p"))).alias("entries"),
    )
    arrays = stored(arrays)
    sizes = arrays.groupBy("lang", "shard").agg(F.max("n_terms").alias("n_terms"))
    # Every group in every shard of its language, also where it has no term.
    frame = (
        numbered.select(
            "lang", "g", "absent", "blocks", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard")
        )
        .join(sizes, ["lang", "shard"], "left")
        .join(arrays.drop("n_terms"), ["lang", "shard", "g"], "left")
    )
    own = F.floor(F.col("g") / BLOCK).cast("int")
    task = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda other: F.struct(F.least(own, other).alias("i"), F.greatest(own, other).alias("j")),
    )
    tasks = frame.select(
        "lang",
        "shard",
        "g",
        F.coalesce("n_terms", F.lit(0).cast("long")).alias("n_terms"),
        "absent",
        F.col("entries.id").alias("ids"),
        F.col("entries.p").alias("prices"),
        F.explode(task).alias("task"),
    ).select("*", "task.*").drop("task")
    sums = (
        tasks.groupBy("lang", "shard", "i", "j")
        .applyInArrow(_pairs, "lang string, a int, b int, ab long, ba long")
        .groupBy("lang", "a", "b")
        .agg(F.sum("ab").alias("ab"), F.sum("ba").alias("ba"))
    )
    both = sums.select(
        "lang",
        F.explode(
            F.array(
                F.struct(F.col("a").alias("g"), F.col("b").alias("other"), F.col("ab").alias("value")),
                F.struct(F.col("b").alias("g"), F.col("a").alias("other"), F.col("ba").alias("value")),
            )
        ).alias("pair"),
    ).select("lang", "pair.*")
    names = numbered.select("lang", "g", "source")
    others = names.select("lang", F.col("g").alias("other"), F.col("source").alias("item"))
    return both.join(names, ["lang", "g"]).join(others, ["lang", "other"]).select(
        "lang", "source", "item", "value"
    )


def gallop(few: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``few`` and in ``many`` (both sorted, without repeats) of what is in both.

    For each stride of ``few`` the reach in ``many`` doubles from where the last one ended until it
    passes the stride; only that reach is searched.
    """
    if len(few) > len(many):
        right, left = gallop(many, few)
        return left, right
    at, mine, theirs = 0, [], []
    for start in range(0, len(few), STRIDE):
        keys = few[start : start + STRIDE]
        reach = len(keys)
        while at + reach < len(many) and many[at + reach - 1] < keys[-1]:
            reach *= 2
        window = many[at : at + reach]
        places = np.searchsorted(window, keys)
        inside = places < len(window)
        hit = np.flatnonzero(inside)
        hit = hit[window[places[hit]] == keys[hit]]
        mine.append(start + hit)
        theirs.append(at + places[hit])
        at += int(np.searchsorted(window, keys[-1], "right"))
        if at >= len(many):
            break
    if not mine:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(mine), np.concatenate(theirs)


def _summed(p: np.ndarray, q) -> int:
    return int(((p - q) ** 2 // q).sum())


def _pairs(table: pa.Table) -> pa.Table:
    """Departures of each pair of groups in one shard that belongs to this pair of blocks."""
    rows = table.to_pylist()
    lang, i, j, n_terms = (rows[0][c] for c in ("lang", "i", "j", "n_terms"))
    groups = [
        (r["g"], r["absent"], np.array(r["ids"] or [], np.int64), np.array(r["prices"] or [], np.int64))
        for r in sorted(rows, key=lambda r: r["g"])
    ]
    out = []
    for x, (a, zero_a, ids_a, prices_a) in enumerate(groups):
        if a // BLOCK != i:
            continue
        for b, zero_b, ids_b, prices_b in groups[x + 1 :]:
            if b // BLOCK != j:
                continue
            at_a, at_b = gallop(ids_a, ids_b)
            p, q = prices_a[at_a], prices_b[at_b]
            only_a, only_b = np.delete(prices_a, at_a), np.delete(prices_b, at_b)
            absent = n_terms - len(ids_a) - len(ids_b) + len(at_a)
            ab = _summed(p, q) + _summed(only_a, zero_b) + _summed(np.int64(zero_a), only_b)
            ba = _summed(q, p) + _summed(np.int64(zero_b), only_a) + _summed(only_b, zero_a)
            ab += absent * ((zero_a - zero_b) ** 2 // zero_b)
            ba += absent * ((zero_b - zero_a) ** 2 // zero_a)
            out.append((lang, a, b, ab, ba))
    columns = list(zip(*out, strict=True)) or [()] * 5
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    return pa.table(
        {
            name: pa.array(column, kind)
            for name, column, kind in zip(("lang", "a", "b", "ab", "ba"), columns, kinds, strict=True)
        }
    )


def term_departures(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``item`` (a term) and ``value``: terms a group has more than its language."""
    p = price(F.col("n"), F.col("n_group"), F.col("v"))
    q = price(F.col("lang_n"), F.col("n_lang"), F.col("v"))
    return (
        terms.join(groups, ["lang", "source"])
        .select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q"))
        .where(F.col("p") > F.col("q"))
        .select("lang", "source", "item", departure(F.col("p"), F.col("q")).alias("value"))
    )


def audit(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    min_docs: int = 3,
    top: int = 200,
) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank``.

    Part ``pair`` ranks all other sources of the language by departure, part ``term`` the ``top``
    terms by which a source departs most from its language. Equal values rank by the item's bytes.
    """
    terms, groups = term_counts(docs, text, lang, source, min_docs)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    def ranked(rows: DataFrame, part: str) -> DataFrame:
        return rows.select(
            "lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank")
        )

    pairs = ranked(pair_departures(terms, groups), "pair")
    best = ranked(term_departures(terms, groups), "term").where(F.col("rank") <= top)
    return pairs.unionByName(best)
