"""SentencePiece encoding and decoding over a table of distinct chunks.

The texts are marked as the model says (a marker for every space, one in front) and cut into
marked words, and these where no piece of the vocabulary reaches over (between letters and
punctuation, around digits and signs that are no part of a longer piece). So the chunks can be
encoded one by one, and equal chunks alike:

1. Blocks of texts (``BLOCK_BYTES``, ``BLOCK_CHUNKS``) are written once, as numbers of chunks by
   position, with the block's own list of chunks. The table is bucketed by block.
2. Slices of the lists, by hash of the chunk, meet in shards. A shard encodes each of its distinct
   chunks once. A chunk comes once per block, so a very frequent one is no hot key; the number
   of shards follows the number of entries.
3. The ids go back to their blocks and are put in by position; the texts don't move.

A vocabulary with pieces that go on over a marker has whole texts as chunks. Decoding concatenates
the vocabulary's strings.

A null text counts as empty: the end id alone. Columns of the result's names are replaced, other
columns pass through, rows stay as they are (repeated ones too), an empty table stays empty.
"""

from __future__ import annotations

import codecs
import re
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from corpusflow.functions.lineage import shared_folder
from corpusflow.llm.frames import append_columns, fresh, texts_of, without

MARKER = "▁"
# Texts and chunks of a block: what a task holds at a time.
BLOCK_BYTES, BLOCK_CHUNKS = 32 << 20, 500_000
# Entries (a chunk of a block) of a shard, and their bytes, on average.
SHARD_ENTRIES, SHARD_BYTES = 600_000, 64 << 20
# Chunks up to this many symbols are merged by looking through all of them.
SHORT = 48
NONE = 1 << 40


def chunk_pattern(pieces: Iterable[str]) -> str:
    """Markers and what a piece may hold after them, longest runs first.

    Characters that stand side by side in a piece are of one class, and so are their neighbours;
    a character of no longer piece is a chunk by itself.
    """
    leader: dict[str, str] = {}

    def of(c: str) -> str:
        while leader.setdefault(c, c) != c:
            c = leader[c]
        return c

    for piece in pieces:
        if len(piece) > 1:
            first, *others = piece.lstrip(MARKER) or MARKER
            of(first)
            for c in others:
                leader[of(c)] = of(first)
    classes: dict[str, list[str]] = {}
    for c in sorted(leader):
        classes.setdefault(of(c), []).append(re.escape(c))
    runs = "|".join(f"[{''.join(c)}]+" for c in classes.values() if c != [MARKER])
    return rf"{MARKER}*(?:{runs})|{MARKER}+|." if runs else f"{MARKER}+|."


class Model:
    """A SentencePiece file of the byte-pair kind: pieces, scores and what joins to what."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as format

        parts = format.ModelProto()
        with open(path, "rb") as file:
            parts.ParseFromString(file.read())
        kinds = format.ModelProto.SentencePiece
        norm, trained = parts.normalizer_spec, parts.trainer_spec
        if trained.model_type != trained.BPE or trained.treat_whitespace_as_suffix:
            raise ValueError(f"{path} is no byte-pair model with the marker in front")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError(f"{path} changes texts before encoding")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in parts.pieces):
            raise ValueError(f"{path} has user-defined or unused pieces")
        self.front = MARKER if norm.add_dummy_prefix else ""
        self.end, self.unknown = trained.eos_id, trained.unk_id
        self.falls_back = trained.byte_fallback
        self.ids = {p.piece: i for i, p in enumerate(parts.pieces) if p.type == kinds.NORMAL}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(parts.pieces) if p.type == kinds.BYTE}
        self.crosses = any(re.search(f"[^{MARKER}]{MARKER}", p) for p in self.ids)
        # The place of a score among all scores, the best first; equal scores share one.
        scores = sorted({parts.pieces[i].score for i in self.ids.values()}, reverse=True)
        place = {score: n for n, score in enumerate(scores)}
        # By a pair of ids: place of the joined piece, and its id.
        self.joins: dict[int, int] = {}
        for piece, number in self.ids.items():
            for cut in range(1, len(piece)):
                left, right = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if left is not None and right is not None:
                    rank = place[parts.pieces[number].score]
                    self.joins[left << 20 | right] = rank << 20 | number
        self.chunk = re.compile(chunk_pattern(self.ids), re.DOTALL)
        # What an id decodes to.
        self.strings = [b""] * len(parts.pieces)
        for i, p in enumerate(parts.pieces):
            if p.type == kinds.NORMAL:
                self.strings[i] = p.piece.replace(MARKER, " ").encode("utf-8")
            elif p.type == kinds.BYTE:
                self.strings[i] = bytes([int(p.piece[1:-1], 16)])
            elif p.type == kinds.UNKNOWN:
                self.strings[i] = trained.unk_surface.encode("utf-8")
        # Ids whose own leading marker is the one in front of a text.
        self.marked = {i for p, i in self.ids.items() if p.startswith(MARKER)} if self.front else set()
        self.silent = {i for i, p in enumerate(parts.pieces) if p.type == kinds.CONTROL}

    def chunks(self, text: str | None) -> list[str]:
        """Chunks of a text in order; joined they are the marked text."""
        if not text:
            return []
        marked = self.front + text.replace(" ", MARKER)
        return [marked] if self.crosses else self.chunk.findall(marked)

    def segment(self, chunk: str) -> list[int]:
        """Ids of a chunk: the best-scored join first, the leftmost among equals."""
        ids = self.ids
        symbols = [ids.get(c, -1) for c in chunk]
        if len(symbols) <= SHORT:
            merged = self._short(symbols)
        else:
            merged = self._long(symbols)
        if -1 not in merged:
            return merged
        rest = iter([c for c in chunk if c not in ids])
        out: list[int] = []
        for symbol in merged:
            if symbol >= 0:
                out.append(symbol)
            elif self.falls_back:
                out.extend(self.bytes[b] for b in next(rest).encode("utf-8"))
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def _short(self, symbols: list[int]) -> list[int]:
        get = self.joins.get
        found = [
            get(a << 20 | b, NONE) if a >= 0 and b >= 0 else NONE
            for a, b in zip(symbols, symbols[1:])
        ]
        ranks = [f >> 20 for f in found]
        none = NONE >> 20
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            new = get(symbols[i] << 20 | symbols[i + 1]) & 0xFFFFF
            symbols[i : i + 2] = [new]
            del ranks[i]
            if i:
                a = symbols[i - 1]
                ranks[i - 1] = get(a << 20 | new, NONE) >> 20 if a >= 0 else none
            if i < len(ranks):
                b = symbols[i + 1]
                ranks[i] = get(new << 20 | b, NONE) >> 20 if b >= 0 else none
        return symbols

    def _long(self, symbols: list[int]) -> list[int]:
        """The same by a queue over linked symbols; entries whose pair has changed are stale."""
        n, get = len(symbols), self.joins.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        gone = [False] * n

        def join(i: int, j: int) -> int | None:
            if symbols[i] < 0 or symbols[j] < 0:
                return None
            return get(symbols[i] << 20 | symbols[j])

        queue = [found >> 20 << 40 | i for i in range(n - 1) if (found := join(i, i + 1)) is not None]
        heapify(queue)
        while queue:
            entry = heappop(queue)
            i = entry & 0xFFFFFFFFFF
            if gone[i] or (j := after[i]) >= n:
                continue
            found = join(i, j)
            if found is None or found >> 20 != entry >> 40:
                continue
            symbols[i], gone[j] = found & 0xFFFFF, True
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (found := join(i, k)) is not None:
                    heappush(queue, found >> 20 << 40 | i)
            h = before[i]
            if h >= 0 and (found := join(h, i)) is not None:
                heappush(queue, found >> 20 << 40 | h)
        return [s for s, g in zip(symbols, gone, strict=True) if not g]

    def text_of(self, ids: list[int]) -> str:
        """The strings of ``ids`` put together; one space in front goes with its marker.

        Bytes that are no text become one replacement character each.
        """
        while ids and ids[-1] in self.silent:
            ids = ids[:-1]
        if not self.silent.isdisjoint(ids):
            return self._text_of_runs(ids)
        data = b"".join(map(self.strings.__getitem__, ids))
        if ids and ids[0] in self.marked:
            data = data[1:]
        return data.decode("utf-8", "corpusflow-each-byte")

    def _text_of_runs(self, ids: list[int]) -> str:
        """With silent ids inside, which end a run of bytes."""
        runs = [[]]
        for i in ids:
            if i in self.silent:
                runs.append([])
            else:
                runs[-1].append(i)
        data = [b"".join(map(self.strings.__getitem__, run)) for run in runs]
        begin = next((n for n, run in enumerate(runs) if run), None)
        if begin is not None and runs[begin][0] in self.marked:
            data[begin] = data[begin][1:]
        return "".join(d.decode("utf-8", "corpusflow-each-byte") for d in data)


codecs.register_error(
    "corpusflow-each-byte", lambda e: ("�" * (e.end - e.start), e.end)
)


@lru_cache(maxsize=4)
def model(path: str) -> Model:
    return Model(path)


def packed_numbers(numbers: np.ndarray) -> bytes:
    """Seven bits a byte, the lowest first; the last byte of a number has its high bit set."""
    rest = numbers.astype(np.uint32)
    out = np.zeros((len(rest), 5), np.uint8)
    used = np.zeros((len(rest), 5), bool)
    alive = np.ones(len(rest), bool)
    for k in range(5):
        more = rest >= 128
        out[:, k] = (rest & 127) | np.where(more, 0, 128).astype(np.uint8)
        used[:, k] = alive
        alive = alive & more
        rest = rest >> 7
        if not alive.any():
            break
    return out[used].tobytes()


def unpacked_numbers(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw & 128)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    numbers = np.zeros(len(last), np.int64)
    for k in range(5):
        at = first + k
        has = at <= last
        if not has.any():
            break
        numbers[has] |= (raw[at[has]] & 127).astype(np.int64) << 7 * k
    return numbers


def hashes_of(chunks: Iterable[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, chunks), np.uint32)


def cut_apart(data: bytes, lengths: np.ndarray) -> list[bytes]:
    ends = np.cumsum(lengths)
    return [data[a:b] for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]


class Block:
    """Texts as numbers of chunks, numbered as they come up."""

    def __init__(self):
        self.numbers = defaultdict(count().__next__)
        self.coded: list[bytes] = []
        self.size = 0

    def add(self, chunks: list[str], size: int) -> None:
        numbers = list(map(self.numbers.__getitem__, chunks))
        self.coded.append(packed_numbers(np.array(numbers, np.uint32)))
        self.size += size

    @property
    def full(self) -> bool:
        return self.size >= BLOCK_BYTES or len(self.numbers) >= BLOCK_CHUNKS

    def listed(self) -> tuple[bytes, bytes, bytes]:
        """The chunks by hash, one after the other; their lengths in bytes, and their numbers."""
        chunks = [c.encode("utf-8") for c in self.numbers]
        order = np.argsort(hashes_of(chunks), kind="stable")
        by_hash = [chunks[i] for i in order.tolist()]
        lengths = np.fromiter(map(len, by_hash), np.uint32, len(by_hash))
        return b"".join(by_hash), packed_numbers(lengths), packed_numbers(order)


def encode(
    docs: DataFrame,
    path: str,
    text: str = "text",
    ids: str = "ids",
    decoded: str | None = None,
    keep_text: bool = True,
) -> DataFrame:
    """Adds ``ids`` of ``text``, the end id last, and what they decode to if ``decoded`` is named.

    Runs jobs while it is called; what they write stays in the shared folder for the session.
    The file must lie at ``path`` on every executor. ``keep_text=False`` leaves the texts out.
    """
    spark = docs.sparkSession
    added = [ids] + ([decoded] if decoded else [])
    kept = [c for c in without(docs, added) if keep_text or c != text]
    block, coded, *of_list = fresh(docs, "block", "coded", "n_chunks", "listed", "lengths", "order")
    n_chunks, listed, lengths, order = of_list
    source = fresh(docs.select(*kept), "source")[0] if text not in kept else text
    rows = docs.select(*kept, *([] if text in kept else [F.col(text).alias(source)]))
    fields = [docs.schema[c] for c in kept]
    nullable = StructType([StructField(f.name, f.dataType, True) for f in fields])
    schema = StructType(
        [
            *nullable,
            StructField(block, LongType()),
            StructField(coded, BinaryType()),
            StructField(n_chunks, LongType()),
            *[StructField(c, BinaryType()) for c in (listed, lengths, order)],
        ]
    )
    arrow = to_arrow_schema(schema)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        split = model(path).chunks
        first = TaskContext.get().partitionId() << 33
        current, done = Block(), 0

        def columns_of_rows(piece: pa.RecordBatch, coded_texts: list[bytes]):
            old = [piece.column(piece.schema.get_field_index(c)) for c in kept]
            n = len(coded_texts)
            blank = [pa.nulls(n, arrow.field(c).type) for c in of_list]
            numbers = pa.array([first + done] * n, pa.int64())
            return pa.RecordBatch.from_arrays(
                [*old, numbers, pa.array(coded_texts, pa.binary()), *blank], schema=arrow
            )

        def list_of_block() -> pa.RecordBatch:
            old = [pa.nulls(1, arrow.field(c).type) for c in kept]
            new = [first + done, None, len(current.numbers), *current.listed()]
            names = [block, coded, *of_list]
            values = [pa.array([v], arrow.field(c).type) for v, c in zip(new, names, strict=True)]
            return pa.RecordBatch.from_arrays([*old, *values], schema=arrow)

        for batch in batches:
            texts = texts_of(batch, source)
            start = 0
            for i, one in enumerate(texts):
                current.add(split(one), len(one or ""))
                if current.full or i + 1 == len(texts):
                    yield columns_of_rows(batch.slice(start, i + 1 - start), current.coded)
                    current.coded, start = [], i + 1
                    if current.full:
                        yield list_of_block()
                        current, done = Block(), done + 1
        if current.numbers:
            yield list_of_block()
        pa.default_memory_pool().release_unused()

    name = f"pieces_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        rows.mapInArrow(number, schema)
        .write.bucketBy(buckets, block)
        .option("path", f"{shared_folder(spark)}/{name}")
        .option("compression", "zstd")
        .saveAsTable(name)
    )
    blocks = spark.table(name)
    lists = blocks.where(F.col(n_chunks).isNotNull())
    totals = lists.agg(F.sum(n_chunks), F.sum(F.octet_length(listed).cast("long"))).first()
    limits = zip(totals, (SHARD_ENTRIES, SHARD_BYTES), strict=True)
    shards = max(1, *(-(-(total or 0) // limit) for total, limit in limits))

    def cut_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lengths = unpacked_numbers(lengths)
                hashed = hashes_of(cut_apart(data, lengths)).astype(np.uint64)
                bounds = np.searchsorted(hashed * shards >> 32, np.arange(shards + 1))
                ends = np.concatenate([[0], np.cumsum(lengths)])
                full = np.flatnonzero(np.diff(bounds))
                spans = list(zip(bounds[full].tolist(), bounds[full + 1].tolist(), strict=True))
                columns = [
                    pa.array(full, pa.int64()),
                    pa.array([number] * len(full), pa.int64()),
                    pa.array([data[ends[a] : ends[b]] for a, b in spans], pa.binary()),
                    pa.array([packed_numbers(lengths[a:b]) for a, b in spans], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "block", "chunks", "lengths"])

    def segment_shard(table: pa.Table) -> pa.Table:
        """Each distinct chunk of the shard once, then the answers block by block."""
        segment = model(path).segment
        packed = [unpacked_numbers(one) for one in table.column("lengths").to_pylist()]
        counts = [len(one) for one in packed]
        ends = np.concatenate([[0], np.cumsum(np.concatenate(packed))]).astype(np.int32)
        data = b"".join(table.column("chunks").to_pylist())
        given = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(data))
        given = given.dictionary_encode()
        found = [segment(c) for c in given.dictionary.to_pylist()]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.int64, int(lengths.sum()))
        starts = np.cumsum(lengths) - lengths
        places = given.indices.to_numpy(zero_copy_only=False)
        answers, sizes = [], []
        for mine in np.split(places, np.cumsum(counts)[:-1]):
            answers.append(packed_numbers(gathered(flat, starts[mine], lengths[mine])))
            sizes.append(packed_numbers(lengths[mine]))
        return pa.table(
            {
                "shard": table.column("shard"),
                "block": table.column("block"),
                "answer": pa.array(answers, pa.binary()),
                "sizes": pa.array(sizes, pa.binary()),
            }
        )

    answers = (
        lists.select(block, listed, lengths)
        .mapInArrow(cut_lists, "shard long, block long, chunks binary, lengths binary")
        .groupBy("shard")
        .applyInArrow(segment_shard, "shard long, block long, answer binary, sizes binary")
    )
    out = StructType([*fields, StructField(ids, ArrayType(IntegerType()))])
    if decoded:
        out = out.add(StructField(decoded, StringType()))
    out_arrow = to_arrow_schema(out)

    def put_in(table: pa.Table, given: pa.Table) -> pa.Table:
        known = model(path)
        given = given.sort_by("shard")
        flat = unpacked_numbers(b"".join(given.column("answer").to_pylist())).astype(np.int32)
        sizes = unpacked_numbers(b"".join(given.column("sizes").to_pylist()))
        starts = np.cumsum(sizes) - sizes
        is_row = table.column(coded).is_valid()
        orders = table.column(order).drop_null().to_pylist()
        if orders:  # none where no text of the block has a chunk
            numbers = unpacked_numbers(orders[0])
            by_number = np.empty((2, len(numbers)), np.int64)
            by_number[:, numbers] = starts, sizes
            starts, sizes = by_number
        rows = table.filter(is_row)
        values, counts, texts = [], [], []
        end = np.array([known.end], np.int32)
        for one in rows.column(coded).to_pylist():
            mine = unpacked_numbers(one)
            row = np.append(gathered(flat, starts[mine], sizes[mine]), end)
            values.append(row)
            counts.append(len(row))
            if decoded:
                texts.append(known.text_of(row.tolist()))
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        together = np.concatenate(values) if values else np.zeros(0, np.int32)
        new = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(together, pa.int32()))]
        if decoded:
            new.append(pa.array(texts, pa.string()))
        old = [rows.column(c) for c in kept]
        return pa.Table.from_arrays([*old, *new], schema=out_arrow)

    coded_rows = blocks.select(*kept, block, coded, order)
    return (
        coded_rows.groupBy(block).cogroup(answers.groupBy("block")).applyInArrow(put_in, out)
    )


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` with these starts and lengths, one after the other."""
    total = int(lengths.sum())
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return flat[np.arange(total) + shift]


def decode(docs: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds ``decoded``, the text of ``ids``. Null ids give the empty text, unknown ones raise."""

    def compute():
        known = model(path)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            rows = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            if any(i is None or not 0 <= i < len(known.strings) for row in rows for i in row or ()):
                raise ValueError("an id that the vocabulary does not have")
            return [pa.array([known.text_of(row or []) for row in rows], pa.string())]

        return work

    return append_columns(docs, [StructField(decoded, StringType())], compute)
