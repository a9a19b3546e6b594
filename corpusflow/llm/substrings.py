"""Exact substring dedup over suffix arrays: repeated strings of ``width`` bytes are removed.

A byte goes if a string of ``width`` bytes that covers it also begins earlier: in a document
with a smaller id, or earlier in its own. Suffix arrays need the strings that may be equal in
one shard, so the work is laid out like this:

1. Every window of ``width`` bytes has an anchor, the leftmost smallest hash of its ``GRAM``-byte
   strings. Windows with the same anchor are neighbours; together they are a context of fewer
   than two widths. Equal windows have equal anchors at the same offset, so windows are compared
   only under one anchor value. Documents are packed into chunks of about ``CHUNK`` bytes with
   their anchors, one row each, in a table bucketed by chunk: later joins never move it.
2. Anchor values that occur once in the corpus end here. Chunks send their distinct values,
   packed by range of value, and get back a bit for each.
3. Contexts under repeated anchors are sent as digests; equal ones need no comparison, as all
   but those of the first document go whole. What is left are first contexts that share an
   anchor with different ones.
4. Those are sent as bytes to shards by anchor. A shard's suffix array is built by induced
   sorting (see ``suffixes``); windows next to each other in it are equal if their permuted
   common prefix reaches the width. Each group keeps its first window.
5. Anchors with over ``HOT`` different contexts don't fit a shard. Their windows are sent as
   digests to the place of their own value instead, where copies meet.
6. Chunks put all answers together.

Copies meet as at most one entry per chunk and value, so no group follows the number of its
copies. Tables lie in the session's shared checkpoint folder.

A null or empty text has 0 bytes and nothing removed. Null ids count as larger than all others.
Rows with one id are neither before each other nor the same document. Extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from corpusflow.functions.lineage import shared_folder
from corpusflow.llm.suffixes import common_prefixes, suffix_array

WIDTH, GRAM = 100, 32
CHUNK = 2_000_000
VALUES_PER_RANGE = 1 << 19
SHARD = 3_000_000
HOT = 15_000
LAST = np.iinfo(np.int64).max

CONTEXT = np.dtype([("anchor", "<u8"), ("x", "<u8"), ("y", "<u8"), ("doc", "<i8")])
GONE, ALONE, COMPARE, SPREAD = 1, 0, 2, 3


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def anchors(data: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Anchor values of a text in order, and how many windows each has."""
    if len(data) < width:
        return np.empty(0, np.uint64), np.empty(0, np.uint8)
    hashes, step = data.astype(np.uint64) + np.uint64(1), 1
    while step < GRAM:
        hashes = _mixed(hashes[:-step] * np.uint64(0xBF58476D1CE4E5B9) + hashes[step:])
        step *= 2
    reach = width - GRAM + 1
    value, place = hashes, np.arange(len(hashes))

    def least(shift: int) -> None:
        nonlocal value, place
        n = len(value) - shift
        right = value[shift:] < value[:n]
        value = np.where(right, value[shift:], value[:n])
        place = np.where(right, place[shift:], place[:n])

    span = 1
    while span * 2 <= reach:
        least(span)
        span *= 2
    if span < reach:
        least(reach - span)
    starts = np.append(0, np.flatnonzero(np.diff(place)) + 1)
    # Smallest hashes are small: mixed once more, they are spread evenly over all ranges.
    return _mixed(value[starts] * np.uint64(0xD6E8FEB86659FD93)), np.diff(np.append(starts, len(place))).astype(np.uint8)


def _packed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) to rows of chunks."""
    coder = zstandard.ZstdCompressor(level=3)
    ids: list[int | None] = []
    texts: list[bytes] = []
    size = 0

    def chunk() -> pa.RecordBatch:
        values, lengths, counts = [], [], []
        for text in texts:
            value, length = anchors(np.frombuffer(text, np.uint8), width)
            values.append(value)
            lengths.append(length)
            counts.append(len(value))
        return pa.RecordBatch.from_pydict(
            {
                "ids": pa.array([ids], pa.list_(pa.int64())),
                "sizes": [np.array([len(t) for t in texts], np.int64).tobytes()],
                "data": [coder.compress(b"".join(texts))],
                "anchors": [np.concatenate(values).tobytes()],
                "windows": [np.concatenate(lengths).tobytes()],
                "counts": [np.array(counts, np.int64).tobytes()],
                "n_anchors": pa.array([sum(counts)], pa.int64()),
            }
        )

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(doc)
            texts.append((text or "").encode("utf-8"))
            size += len(texts[-1])
            if size >= CHUNK:
                yield chunk()
                ids, texts, size = [], [], 0
    if ids:
        yield chunk()


PACKED = (
    "ids array<long>, sizes binary, data binary, anchors binary, windows binary, counts binary,"
    " n_anchors long"
)


class Chunk:
    """A row of the chunk table, unpacked; with the answers that it has got so far."""

    def __init__(self, row: dict, width: int):
        self.width = width
        self.values = np.frombuffer(row["anchors"], np.uint64)
        counts = np.frombuffer(row["counts"], np.int64)
        self.row = np.repeat(np.arange(len(counts)), counts)
        lengths = np.frombuffer(row["windows"], np.uint8).astype(np.int64)
        before = np.cumsum(lengths) - lengths
        of_row = np.append(before, 0)[np.cumsum(counts) - counts]
        self.start, self.windows = before - np.repeat(of_row, counts), lengths
        self.answers = {(a["kind"], a["part"]): a["answer"] for a in row.get("answers") or []}
        if "data" in row:
            self.ids = row["ids"]
            self.order = np.array([LAST if i is None else i for i in self.ids], np.int64)
            self.sizes = np.frombuffer(row["sizes"], np.int64)
            self.data = zstandard.ZstdDecompressor().decompress(row["data"])
            self.base = np.cumsum(self.sizes) - self.sizes

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchor values and the place of each anchor's value among them."""
        return np.unique(self.values, return_inverse=True)

    def repeated(self, bits: int) -> np.ndarray:
        """Numbers of the anchors whose value occurs again anywhere."""
        values, inverse = self.distinct()
        again = np.bincount(inverse, minlength=len(values)) > 1
        for part, a, b in parts(values, bits):
            answer = np.frombuffer(self.answers["repeats", part], np.uint8)
            again[a:b] |= np.unpackbits(answer, count=b - a).astype(bool)
        return np.flatnonzero(again[inverse])

    def contexts(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Digest entries, the anchor each comes from, and anchors that repeat one in a row.

        An entry per row and distinct context, in the order of anchor values.
        """
        chosen = self.repeated(bits)
        entries = np.empty(len(chosen), CONTEXT)
        entries["anchor"] = self.values[chosen]
        entries["doc"] = self.order[self.row[chosen]] if len(chosen) else 0
        starts = (self.base[self.row[chosen]] + self.start[chosen]).tolist()
        ends = (np.array(starts, np.int64) + self.windows[chosen] + self.width - 1).tolist()
        digest, data = xxhash.xxh3_128_digest, self.data
        pairs = b"".join(digest(data[a:b]) for a, b in zip(starts, ends, strict=True))
        halves = np.frombuffer(pairs, "<u8").reshape(-1, 2)
        entries["x"], entries["y"] = halves[:, 0], halves[:, 1]
        order = np.lexsort(
            (chosen, self.row[chosen], entries["y"], entries["x"], entries["anchor"])
        )
        entries, chosen = entries[order], chosen[order]
        row = self.row[chosen]
        same = np.zeros(len(chosen), bool)
        same[1:] = (
            (entries["x"][1:] == entries["x"][:-1])
            & (entries["y"][1:] == entries["y"][:-1])
            & (row[1:] == row[:-1])
        )
        return entries[~same], chosen[~same], chosen[same]

    def states(self, entries: np.ndarray, bits: int) -> np.ndarray:
        states = np.zeros(len(entries), np.uint8)
        for part, a, b in parts(entries["anchor"], bits):
            states[a:b] = np.frombuffer(self.answers["contexts", part], np.uint8)
        return states

    def spread(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Digests of every window of ``chosen`` anchors by value, with row and start."""
        rows = np.repeat(self.row[chosen], self.windows[chosen])
        lengths = self.windows[chosen]
        offset = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        starts = np.repeat(self.start[chosen], lengths) + offset
        places = (self.base[rows] + starts).tolist()
        digest, data, width = xxhash.xxh3_128_digest, self.data, self.width
        pairs = b"".join(digest(data[a : a + width]) for a in places)
        halves = np.frombuffer(pairs, "<u8").reshape(-1, 2)
        entries = np.empty(len(rows), CONTEXT)
        entries["anchor"], entries["x"], entries["y"] = halves[:, 0], halves[:, 0], halves[:, 1]
        entries["doc"] = self.order[rows]
        order = np.lexsort((starts, rows, halves[:, 1], halves[:, 0]))
        return entries[order], rows[order], starts[order]


def parts(values: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """Ranges of sorted 64-bit values by their highest ``bits``: number, begin and end."""
    if not len(values):
        return
    number = (values >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(values), int)
    kinds, first, many = np.unique(number, return_index=True, return_counts=True)
    for part, a, n in zip(kinds.tolist(), first.tolist(), many.tolist(), strict=True):
        yield part, a, a + n


def bits_for(total: int, each: int) -> int:
    """Bits of a range so that ``total`` makes parts of about ``each``."""
    return max(3, int(max(0, total - 1) // each).bit_length())


ANSWER = pa.schema(
    [
        ("chunk", pa.int64()),
        ("kind", pa.string()),
        ("part", pa.int64()),
        ("answer", pa.binary()),
        ("n_compare", pa.int64()),
        ("n_spread", pa.int64()),
    ]
)
ANSWER_TYPE = (
    "chunk long, kind string, part long, answer binary, n_compare long, n_spread long"
)


def _answers(table: pa.Table, kind: str, answers: list[bytes]) -> pa.Table:
    """One answer per row of ``table``; with the number of contexts still to be looked at."""
    states = kind == "contexts"
    return pa.table(
        [
            table.column("chunk"),
            pa.array([kind] * len(table), pa.string()),
            table.column("part"),
            pa.array(answers, pa.binary()),
            pa.array([a.count(COMPARE) if states else 0 for a in answers], pa.int64()),
            pa.array([a.count(SPREAD) if states else 0 for a in answers], pa.int64()),
        ],
        schema=ANSWER,
    )


def _repeats(table: pa.Table) -> pa.Table:
    """Which of the chunks' distinct values any other chunk has too."""
    arrays = [np.frombuffer(v, np.uint64) for v in table.column("entries").to_pylist()]
    _, inverse, counts = np.unique(
        np.concatenate(arrays), return_inverse=True, return_counts=True
    )
    again = (counts > 1)[inverse]
    ends = np.cumsum([len(a) for a in arrays])
    bits = [np.packbits(p).tobytes() for p in np.split(again, ends[:-1])]
    return _answers(table, "repeats", bits)


def _firsts(kind: str, hot: int):
    """State of every context: gone, alone under its anchor, or to be compared."""

    def judge(table: pa.Table) -> pa.Table:
        arrays = [np.frombuffer(v, CONTEXT) for v in table.column("entries").to_pylist()]
        entries = np.concatenate(arrays)
        order = np.lexsort((entries["doc"], entries["y"], entries["x"], entries["anchor"]))
        ranked = entries[order]
        new_anchor = np.append(True, ranked["anchor"][1:] != ranked["anchor"][:-1])
        new = new_anchor.copy()
        new[1:] |= (ranked["x"][1:] != ranked["x"][:-1]) | (ranked["y"][1:] != ranked["y"][:-1])
        context, anchor = np.cumsum(new) - 1, np.cumsum(new_anchor) - 1
        gone = ranked["doc"] > ranked["doc"][new][context]
        different = np.bincount(anchor, new)[anchor]
        state = np.where(different > hot, SPREAD, np.where(different > 1, COMPARE, ALONE))
        states = np.empty(len(entries), np.uint8)
        states[order] = np.where(gone, GONE, state)
        ends = np.cumsum([len(a) for a in arrays])
        return _answers(table, kind, [s.tobytes() for s in np.split(states, ends[:-1])])

    return judge


def _shard(width: int):
    """Windows of a shard that are not the first of their value, by its suffix array."""

    def compare(table: pa.Table) -> pa.Table:
        contexts, docs, rows, chunks, starts = [], [], [], [], []
        for k, chunk in enumerate(table.to_pylist()):
            heads = np.frombuffer(chunk["entries"], np.int64).reshape(-1, 4)  # doc row start size
            ends = np.cumsum(heads[:, 3])
            data = chunk["bytes"]
            contexts += [data[e - n : e] for e, n in zip(ends.tolist(), heads[:, 3].tolist(), strict=True)]
            docs.append(heads[:, 0])
            rows.append(heads[:, 1])
            starts.append(heads[:, 2])
            chunks.append(np.full(len(heads), k))
        docs, rows, starts, chunks = map(np.concatenate, (docs, rows, starts, chunks))
        lengths = np.array([len(c) for c in contexts])
        # Symbols from 1 on, a 0 after each context.
        text = np.zeros(lengths.sum() + len(lengths), np.int64)
        heads = np.cumsum(lengths + 1) - lengths - 1
        inside = np.ones(len(text), bool)
        inside[heads + lengths] = False
        text[inside] = np.frombuffer(b"".join(contexts), np.uint8).astype(np.int64) + 1
        owner = np.repeat(np.arange(len(lengths)), lengths + 1)
        offset = np.arange(len(text)) - heads[owner]
        is_window = offset <= lengths[owner] - width
        order = suffix_array(text)
        order = order[is_window[order]]
        equal = common_prefixes(text, order, width)[order] >= width
        group = np.cumsum(~equal)
        of = owner[order]
        place = starts[of] + offset[order]
        # Gone: a smaller document in the group, or an earlier place in the same row.
        ranked = np.lexsort((place, rows[of], chunks[of], docs[of], group))
        g, o, p = group[ranked], of[ranked], place[ranked]
        fresh = np.append(True, g[1:] != g[:-1])
        least = docs[o][fresh][np.cumsum(fresh) - 1]
        gone = docs[o] > least
        gone[1:] |= ~fresh[1:] & (rows[o][1:] == rows[o][:-1]) & (chunks[o][1:] == chunks[o][:-1])
        o, p = o[gone], p[gone]
        answers = []
        for k in range(len(table)):
            mine = chunks[o] == k
            answers.append(np.stack([rows[o[mine]], p[mine]], axis=1).astype("<i4").tobytes())
        return _answers(table, "windows", answers)

    return compare


def repeated_substrings(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH
) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``spans`` (removed byte ranges) and ``kept`` (bytes) per row.

    ``width`` is from ``GRAM`` to 255 + ``GRAM`` bytes. Runs jobs while it is called.
    """
    if not GRAM <= width <= 255 + GRAM - 1:
        raise ValueError(f"width must be from {GRAM} to {255 + GRAM - 1}")
    spark = docs.sparkSession
    name = f"chunks_{uuid.uuid4().hex}"
    folder = f"{shared_folder(spark)}/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def stored(df: DataFrame, part: str) -> DataFrame:
        df.write.parquet(f"{folder}/{part}")
        return spark.read.parquet(f"{folder}/{part}")

    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"))
    packed = rows.mapInArrow(lambda batches: _packed(batches, width), PACKED)
    (
        packed.withColumn("chunk", F.monotonically_increasing_id())
        .write.bucketBy(buckets, "chunk")
        .option("path", f"{folder}/chunks")
        .option("compression", "none")
        .saveAsTable(name)
    )
    chunks = spark.table(name)
    total = chunks.agg(F.sum("n_anchors")).first()[0] or 0
    bits = bits_for(total, VALUES_PER_RANGE)

    def of_chunks(columns: list[str], answers: DataFrame | None, emit, schema: str) -> DataFrame:
        """``emit(chunk number, Chunk)`` yields dictionaries of rows."""
        table = chunks.select("chunk", *columns)
        if answers is not None:
            by_chunk = answers.groupBy("chunk").agg(
                F.collect_list(F.struct("kind", "part", "answer")).alias("answers")
            )
            table = table.join(by_chunk.hint("shuffle_hash"), "chunk", "left")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    row = batch.slice(k, 1).to_pylist()[0]
                    found = list(emit(row["chunk"], Chunk(row, width)))
                    if found:
                        yield pa.RecordBatch.from_pylist(found, arrow)

        arrow = to_arrow_schema(_parse_datatype_string(schema))
        return table.mapInArrow(run, schema)

    entries = "part long, chunk long, entries binary"
    base = ["anchors", "windows", "counts"]
    every = [*base, "ids", "sizes", "data"]

    def send_values(number: int, chunk: Chunk):
        values, _ = chunk.distinct()
        for part, a, b in parts(values, bits):
            yield {"part": part, "chunk": number, "entries": values[a:b].tobytes()}

    repeats = stored(
        of_chunks(base, None, send_values, entries)
        .groupBy("part")
        .applyInArrow(_repeats, ANSWER_TYPE),
        "repeats",
    )

    def send_contexts(number: int, chunk: Chunk):
        found, _, _ = chunk.contexts(bits)
        for part, a, b in parts(found["anchor"], bits):
            yield {"part": part, "chunk": number, "entries": found[a:b].tobytes()}

    states = stored(
        of_chunks(every, repeats, send_contexts, entries)
        .groupBy("part")
        .applyInArrow(_firsts("contexts", HOT), ANSWER_TYPE),
        "states",
    )
    known = repeats.unionByName(states)

    left = states.agg(F.sum("n_compare"), F.sum("n_spread")).first()
    n_compare, n_spread = left[0] or 0, left[1] or 0
    shard_bits = bits_for(n_compare * (width + width // 3), SHARD)

    def send_bytes(number: int, chunk: Chunk):
        found, origin, _ = chunk.contexts(bits)
        mine = chunk.states(found, bits) == COMPARE
        found, origin = found[mine], origin[mine]
        heads = np.stack(
            [
                found["doc"],
                chunk.row[origin],
                chunk.start[origin],
                chunk.windows[origin] + width - 1,
            ],
            axis=1,
        ).astype(np.int64)
        begins = chunk.base[heads[:, 1]] + heads[:, 2]
        for part, a, b in parts(found["anchor"], shard_bits):
            cut = zip(begins[a:b].tolist(), heads[a:b, 3].tolist(), strict=True)
            yield {
                "part": part,
                "chunk": number,
                "entries": heads[a:b].tobytes(),
                "bytes": b"".join(chunk.data[s : s + n] for s, n in cut),
            }

    windows = stored(
        of_chunks(every, known, send_bytes, entries + ", bytes binary")
        .groupBy("part")
        .applyInArrow(_shard(width), ANSWER_TYPE),
        "windows",
    )
    spread = spark.createDataFrame([], ANSWER_TYPE)
    spread_bits = bits_for(n_spread * width // 3, VALUES_PER_RANGE)
    if n_spread:

        def send_windows(number: int, chunk: Chunk):
            found, origin, _ = chunk.contexts(bits)
            own, _, _ = chunk.spread(origin[chunk.states(found, bits) == SPREAD])
            for part, a, b in parts(own["anchor"], spread_bits):
                yield {"part": part, "chunk": number, "entries": own[a:b].tobytes()}

        spread = stored(
            of_chunks(every, known, send_windows, entries)
            .groupBy("part")
            .applyInArrow(_firsts("spread", HOT), ANSWER_TYPE),
            "spread",
        )

    def finish(number: int, chunk: Chunk):
        found, origin, again = chunk.contexts(bits)
        states = chunk.states(found, bits)
        total_bytes = len(chunk.data)
        change = np.zeros(total_bytes + 1, np.int64)

        def remove(row: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
            begin = chunk.base[row] + start
            np.add.at(change, begin, 1)
            np.add.at(change, begin + length, -1)

        whole = np.concatenate([again, origin[states == GONE]])
        remove(chunk.row[whole], chunk.start[whole], chunk.windows[whole] + width - 1)
        for (kind, _), answer in chunk.answers.items():
            if kind == "windows":
                pairs = np.frombuffer(answer, "<i4").reshape(-1, 2).astype(np.int64)
                remove(pairs[:, 0], pairs[:, 1], np.full(len(pairs), width))
        if (states == SPREAD).any():
            own, rows, starts = chunk.spread(origin[states == SPREAD])
            gone = np.zeros(len(own), bool)
            for part, a, b in parts(own["anchor"], spread_bits):
                gone[a:b] = np.frombuffer(chunk.answers["spread", part], np.uint8) == GONE
            gone[1:] |= (
                (own["x"][1:] == own["x"][:-1])
                & (own["y"][1:] == own["y"][:-1])
                & (rows[1:] == rows[:-1])
            )
            remove(rows[gone], starts[gone], np.full(int(gone.sum()), width))
        removed = np.cumsum(change[:-1]) > 0
        for k, doc in enumerate(chunk.ids):
            a, n = int(chunk.base[k]), int(chunk.sizes[k])
            own = removed[a : a + n]
            if own.any():
                edges = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
                spans = edges.reshape(-1, 2).tolist()
                data = chunk.data[a : a + n]
                begins, ends = [0] + [e for _, e in spans], [s for s, _ in spans] + [n]
                kept = b"".join(data[x:y] for x, y in zip(begins, ends, strict=True))
            else:
                spans, kept = [], chunk.data[a : a + n]
            yield {
                "doc_id": doc,
                "n_bytes": n,
                "spans": [{"start": s, "end": e} for s, e in spans],
                "kept": kept,
            }

    answers = known.unionByName(windows).unionByName(spread)
    return of_chunks(
        every,
        answers,
        finish,
        "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary",
    )
