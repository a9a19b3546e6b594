"""Benchmark decontamination: edit distance by CGK embeddings, bit-sampling LSH, verification.

Words are symbols. The CGK embedding of a sequence is a random walk over it: at step j it
copies the current word and moves on or stays, as a random bit of (walk, step, word) says.
Sequences at a small edit distance have walks that fall back into step, so their embeddings
have a small Hamming distance. Each of ``WALKS`` walks is sampled ``SAMPLES`` times at
``COORDINATES`` of its ``STEPS`` steps; equal samples are candidates. Every candidate is
verified by the exact word edit distance of the item to the passage around the window.

Windows begin at every ``STRIDE``-th word of a document, while items are embedded from
``STRIDE`` neighbouring offsets, so that one of them is in line wherever a passage begins;
longer items are embedded again from every ``SEGMENT``-th word on. Items under ``LONG`` words,
which give a walk too few places, and those with less than half of their samples (fewer than
three different words in each) are found by parts instead: cut into one part more than the edits
allowed, one part at least stands unedited in every passage, so none is missed. Of longer ones
``RECALL`` are found at least, at every length and rate of edits. Items under ``SHORT`` words must be
equal.

An item is found where a passage is within ``max_edits`` times its words (rounded down) edits;
case and punctuation around words do not count. Null or empty texts and items are found
nowhere and hold nothing; repeated items are reported each. Items are broadcast in blocks of
at most ``BLOCK_WORDS`` words, one pass over the documents per block. Documents are not
shuffled. A column named like the result is replaced, others pass through.
"""

from __future__ import annotations

import string
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from corpusflow.llm.bpe import CACHED_HASHES, Generations
from corpusflow.llm.frames import append_columns, texts_of

WALKS, STEPS = 4, 20
SAMPLES, COORDINATES = 12, 4
STRIDE, SEGMENT, SHORT, LONG = 4, 12, 8, 24
PART = 7  # words of a part that are looked up
RECALL = 0.995
MAX_EDITS = 0.15
BLOCK_WORDS = 1_000_000
SEED = 11

_MARKS = string.punctuation + "«»„“”‘’¿¡…–—"


def _hash(word: str) -> int:
    bare = word.strip(_MARKS)
    return xxhash.xxh3_64_intdigest(bare) | 1 if bare else 0


@lru_cache(maxsize=1)
def _word_hashes() -> Generations:
    return Generations(_hash, CACHED_HASHES)


def words(text: str | None) -> np.ndarray:
    """Hashes of the words of a text; marks that stand alone are none."""
    parts = (text or "").lower().split()
    hashes = np.fromiter(map(_word_hashes().__getitem__, parts), np.uint64, len(parts))
    return hashes[hashes != 0]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def sampled_steps() -> list[list[np.ndarray]]:
    """Per walk and sample the steps, one from each part of the walk.

    Every other sample keeps to the first half of the walk, for items whose rest is short.
    """
    draw = np.random.default_rng(SEED)
    parts = np.arange(COORDINATES)

    def sample(m: int) -> np.ndarray:
        span = STEPS / (1 + m % 2) / COORDINATES
        return ((parts + draw.random(COORDINATES)) * span).astype(np.int64)

    return [[sample(m) for m in range(SAMPLES)] for _ in range(WALKS)]


def window_keys(symbols: np.ndarray, starts: np.ndarray, distinct: int = 1):
    """Yields the keys of every sample of the walks from ``starts``; 0 stands for none.

    A sample with fewer than ``distinct`` different words is none, as it says too little.
    ``symbols`` must go on for ``STEPS`` zeros after each text.
    """
    number = 0
    for walk, samples in enumerate(sampled_steps()):
        bits = mixed(symbols + np.uint64(walk + 1))
        place, seen = starts.copy(), []
        for step in range(STEPS):
            seen.append(symbols[place])
            place += ((bits[place] >> np.uint64(step)) & np.uint64(1)).astype(place.dtype)
        for steps in samples:
            key = np.full(len(starts), number + 1, np.uint64)
            for step in steps:
                key = mixed(key + seen[step])
            key[seen[steps[-1]] == 0] = 0  # the walk has left the text: no sample
            if distinct > 1:
                ranked = np.sort(np.stack([seen[step] for step in steps]), axis=0)
                key[1 + (np.diff(ranked, axis=0) != 0).sum(axis=0) < distinct] = 0
            yield key
            number += 1


def edit_distance(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Least edits that turn ``item`` into any part of ``passage``, and where that part ends."""
    columns = np.arange(len(passage) + 1)
    row = np.zeros(len(passage) + 1, np.int64)
    for i, word in enumerate(item):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (passage != word), row[1:] + 1)
        row = np.minimum.accumulate(new - columns) + columns  # insertions run to the right
    end = int(row.argmin())
    return int(row[end]), end


class Table:
    """Numbers by key, for many lookups of which few succeed; the key 0 is none."""

    def __init__(self, keys: np.ndarray, numbers: np.ndarray):
        order = np.argsort(keys, kind="stable")
        order = order[np.count_nonzero(keys == 0) :]
        self.keys, self.numbers = keys[order], numbers[order]
        self.shift = np.uint64(64 - max(16, min(26, int(len(keys) * 64).bit_length())))
        self.marked = np.zeros(1 << int(64 - int(self.shift)), bool)
        self.marked[(self.keys >> self.shift).astype(np.int64)] = True

    def hits(self, keys: np.ndarray):
        """Yields position in ``keys`` and the numbers it finds."""
        hits = np.flatnonzero(self.marked[(keys >> self.shift).astype(np.int64)])
        low = np.searchsorted(self.keys, keys[hits], "left")
        high = np.searchsorted(self.keys, keys[hits], "right")
        held = low < high
        for hit, a, b in zip(hits[held].tolist(), low[held], high[held], strict=True):
            yield hit, self.numbers[a:b]


class Items:
    """One block of benchmark items, embedded; lives in every task."""

    def __init__(self, ids: list[int], texts: list[str], max_edits: float):
        self.ids, self.max_edits = ids, max_edits
        self.words = [words(t) for t in texts]
        places: list[tuple[int, int]] = []  # item and offset of every embedded start
        for n, item in enumerate(self.words):
            if len(item) >= LONG:
                for first in range(0, len(item) - SEGMENT + 1, SEGMENT):
                    places += [(n, first + k) for k in range(STRIDE)]
        rest = np.zeros(STEPS, np.uint64)
        flat = np.concatenate([*[np.append(w, rest) for w in self.words], rest])
        offsets = np.cumsum([0] + [len(w) + STEPS for w in self.words])
        self.places = np.array(places, np.int64).reshape(-1, 2)
        starts = offsets[self.places[:, 0]] + self.places[:, 1]
        every = np.concatenate(list(window_keys(flat, starts, distinct=3)))
        of = np.tile(np.arange(len(starts)), len(every) // max(1, len(starts)))
        self.samples = Table(every, of)
        said = np.bincount(self.places[of[every != 0], 0], minlength=len(ids))
        embedded = said * 2 > np.bincount(self.places[of, 0], minlength=len(ids))
        parts: list[tuple[int, int, int]] = []  # length, item and offset
        for n, item in enumerate(self.words):
            if len(item) and not embedded[n]:
                cuts = min(self._most(len(item)) + 1, len(item))
                bounds = [len(item) * k // cuts for k in range(cuts + 1)]
                parts += [(min(PART, b - a), n, a) for a, b in zip(bounds, bounds[1:])]
        self.parts = np.array(parts, np.int64).reshape(-1, 3)
        self.by_length: dict[int, Table] = {}
        for length, keys in self._runs(flat, set(self.parts[:, 0].tolist())):
            own = np.flatnonzero(self.parts[:, 0] == length)
            at = offsets[self.parts[own, 1]] + self.parts[own, 2]
            self.by_length[length] = Table(keys[at], own)

    def _most(self, length: int) -> int:
        return int(self.max_edits * length) if length >= SHORT else 0

    @staticmethod
    def _runs(symbols: np.ndarray, lengths):
        """Yields each of ``lengths`` with the keys of the runs of so many words from every place."""
        key = np.ones(len(symbols), np.uint64)
        for k in range(max(lengths, default=0)):
            key = mixed(key[: len(symbols) - k] + symbols[k:])
            if k + 1 in lengths:
                yield k + 1, key

    def found(self, docs: list[np.ndarray]) -> list[dict[int, tuple[int, int]]]:
        """Per document: item number to (edits, first word of the passage)."""
        rest = np.zeros(STEPS, np.uint64)
        flat = np.concatenate([part for d in docs for part in (d, rest)])
        ends = np.cumsum([len(d) + STEPS for d in docs])
        firsts = ends - [len(d) + STEPS for d in docs]
        found: list[dict[int, tuple[int, int]]] = [{} for _ in docs]
        tried: set[tuple[int, int, int]] = set()

        def check(at: int, places: np.ndarray) -> None:
            doc = int(np.searchsorted(ends, at, "right"))
            for item, offset in places.tolist():
                place = at - int(firsts[doc]) - offset
                if (doc, item, place) not in tried:
                    tried.add((doc, item, place))
                    self._verify(docs[doc], item, place, found[doc])

        if len(self.places):
            starts = np.concatenate(
                [np.arange(a, a + len(d), STRIDE) for a, d in zip(firsts, docs, strict=True)]
            )
            for keys in window_keys(flat, starts):
                for hit, numbers in self.samples.hits(keys):
                    check(int(starts[hit]), self.places[numbers])
        for length, keys in self._runs(flat, self.by_length):
            for at, numbers in self.by_length[length].hits(keys):
                check(at, self.parts[numbers, 1:])
        return found

    def _verify(self, doc: np.ndarray, item: int, place: int, found: dict) -> None:
        wanted = self.words[item]
        most = self._most(len(wanted))
        if found.get(item, (most + 1,))[0] == 0:
            return
        if place >= 0 and np.array_equal(doc[place : place + len(wanted)], wanted):
            found[item] = (0, place)
            return
        first = max(0, place - most)
        passage = doc[first : max(0, place + len(wanted) + most)]
        # Words that the passage lacks cost an edit each: most candidates end here.
        if np.count_nonzero(~np.isin(wanted, passage)) > most:
            return
        edits, end = edit_distance(wanted, passage)
        if edits <= most and edits < found.get(item, (most + 1,))[0]:
            found[item] = (edits, max(0, first + end - len(wanted)))


LEAK = StructType(
    [StructField(name, LongType()) for name in ("item_id", "edits", "first_word")]
)
ARROW_LEAK = pa.struct([(name, pa.int64()) for name in ("item_id", "edits", "first_word")])


def item_blocks(items: DataFrame, item_id: str = "item_id", text: str = "text"):
    """Yields ids and texts of the items in blocks of bounded size, smallest ids first in each."""
    usable = items.where(F.col(text).rlike(r"\S") & F.col(item_id).isNotNull()).select(
        F.col(item_id).cast("long").alias("_item"), F.col(text).alias("_text")
    )
    total = usable.agg(F.sum(F.size(F.split("_text", r"\s+")))).first()[0] or 0
    blocks = -(-total // BLOCK_WORDS)
    for block in range(blocks):
        mine = F.pmod(F.xxhash64("_item", "_text"), F.lit(blocks)) == block
        rows = sorted((r["_item"], r["_text"]) for r in usable.where(mine).collect())
        yield [r[0] for r in rows], [r[1] for r in rows]


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    leaks: str = "leaks",
    item_id: str = "item_id",
    item_text: str = "text",
    max_edits: float = MAX_EDITS,
) -> DataFrame:
    """Adds ``leaks``: item id, edits and first word of every benchmark item in ``text``."""
    parts = []
    for ids, texts in item_blocks(items, item_id, item_text):
        docs = _with_block(docs, ids, texts, text, f"_leaks_{len(parts)}", max_edits)
        parts.append(f"_leaks_{len(parts)}")
    kept = [c for c in docs.columns if c not in parts and c.lower() != leaks.lower()]
    empty = F.array().cast("array<struct<item_id:bigint,edits:bigint,first_word:bigint>>")
    found = F.array_sort(F.concat(*parts)) if parts else empty
    return docs.select(*kept, found.alias(leaks))


def _with_block(
    docs: DataFrame, ids: list[int], texts: list[str], text: str, column: str, max_edits: float
) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((ids, texts))

    def compute():
        block = Items(*shared.value, max_edits)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            found = block.found([words(t) for t in texts_of(batch, text)])
            rows = [
                [
                    {"item_id": ids_[n], "edits": e, "first_word": p}
                    for n, (e, p) in sorted(row.items())
                ]
                for row in found
            ]
            return [pa.array(rows, pa.list_(ARROW_LEAK))]

        ids_ = block.ids
        return work

    return append_columns(docs, [StructField(column, ArrayType(LEAK))], compute, rows=256)
