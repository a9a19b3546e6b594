"""Byte-pair encoding, decoding and token counts with the files of public tokenizers.

Merging a word is a priority queue of merge ranks over a doubly linked list of symbols: the
lowest rank (then the leftmost place) is popped, entries whose symbols have changed since are
skipped, and the two new neighbours of a merged symbol are pushed. Words repeat, so each
Python worker keeps merged words in a bounded cache; texts are read once, without a shuffle.

A null text counts as empty: no tokens. Columns of the result's names are replaced, other
columns pass through, rows stay as they are (repeated ones too), an empty table stays empty.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField

from corpusflow.llm.frames import append_columns, list_array, texts_of

# Entries per generation of a cache, two of which live; a Python worker keeps them over stages.
CACHED_WORDS = 80_000
CACHED_HASHES = 40_000

# Letters and numbers that Unicode has had only since version 17, which the
# tokenizers library does not know yet.
NEWER_LETTERS = (
    r"\U00000558-\U00000558\U0000058B-\U0000058C\U0000088F-\U0000088F\U00000C5C-\U00000C5C"
    r"\U00000CDC-\U00000CDC\U0000208F-\U0000208F\U0000209D-\U0000209F\U0000A7CE-\U0000A7CF"
    r"\U0000A7D2-\U0000A7D2\U0000A7D4-\U0000A7D4\U0000A7DD-\U0000A7DD\U0000A7E2-\U0000A7E2"
    r"\U0000A7F1-\U0000A7F1\U0000AB6C-\U0000AB6D\U000107BB-\U000107BF\U00010940-\U00010959"
    r"\U00010EC5-\U00010EC7\U00010ED9-\U00010EEE\U00011B0A-\U00011B0A\U00011DB0-\U00011DDB"
    r"\U00011DF1-\U00011DF1\U00016EA0-\U00016EB8\U00016EBB-\U00016ED3\U00016FF2-\U00016FF3"
    r"\U000187F8-\U000187FF\U00018CD6-\U00018CDA\U00018D09-\U00018D20\U00018D80-\U00018DF2"
    r"\U00018E00-\U00019191\U000191A0-\U000191D2\U0001B123-\U0001B128\U0001B168-\U0001B168"
    r"\U0001D6A6-\U0001D6A6\U0001DF1F-\U0001DF24\U0001DF2B-\U0001DF81\U0001DF90-\U0001DF96"
    r"\U0001DFCD-\U0001DFFF\U0001E6C0-\U0001E6DE\U0001E6E0-\U0001E6E2\U0001E6E4-\U0001E6E5"
    r"\U0001E6E7-\U0001E6ED\U0001E6F0-\U0001E6F4\U0001E6FE-\U0001E6FF\U0002B73A-\U0002B73F"
    r"\U0002B81E-\U0002B81E\U0002CEA2-\U0002CEAD\U000323B0-\U00033479\U0003D000-\U0003FC3F"
)
NEWER_NUMBERS = (
    r"\U00011DE0-\U00011DE9\U0001246F-\U0001246F\U00012475-\U0001247F\U00012550-\U00012686"
    r"\U00016FF4-\U00016FF6"
)
# Capitals whose small form the tokenizers library knows and Python 3.13 doesn't.
NEWER_SMALL = {
    0x1C89: 0x1C8A,
    0xA7CB: 0x0264,
    0xA7CC: 0xA7CD,
    0xA7CE: 0xA7CF,
    0xA7D2: 0xA7D3,
    0xA7D4: 0xA7D5,
    0xA7DA: 0xA7DB,
    0xA7DC: 0x019B,
    **{capital: capital + 0x20 for capital in range(0x10D50, 0x10D66)},
    **{capital: capital + 0x1B for capital in range(0x16EA0, 0x16EB9)},
}
# Signs that the normalizer of the tokenizers library neither moves nor composes.
NEWER_SIGNS = (
    r"\U000007FD-\U000007FD\U00000898-\U0000089F\U000008CA-\U000008D3\U000009FE-\U000009FE"
    r"\U00000C3C-\U00000C3C\U00000D3B-\U00000D3C\U00000EBA-\U00000EBA\U00001715-\U00001715"
    r"\U00001ABF-\U00001ACE\U00001DF6-\U00001DFA\U0000A82C-\U0000A82C\U00010D24-\U00010D27"
    r"\U00010EAB-\U00010EAC\U00010EFD-\U00010EFF\U00010F46-\U00010F50\U00010F82-\U00010F85"
    r"\U00011070-\U00011070\U0001133B-\U0001133B\U0001145E-\U0001145E\U00011839-\U0001183A"
    r"\U00011930-\U00011930\U0001193D-\U0001193E\U00011943-\U00011943\U000119E0-\U000119E0\U00011A34-\U00011A34"
    r"\U00011A47-\U00011A47\U00011A99-\U00011A99\U00011D42-\U00011D42\U00011D44-\U00011D45"
    r"\U00011D97-\U00011D97\U00011F41-\U00011F42\U00016FF0-\U00016FF1\U0001E08F-\U0001E08F"
    r"\U0001E130-\U0001E136\U0001E2AE-\U0001E2AE\U0001E2EC-\U0001E2EF\U0001E4EC-\U0001E4EF"
)
LETTER, NUMBER = rf"[\p{{L}}--[{NEWER_LETTERS}]]", rf"[\p{{N}}--[{NEWER_NUMBERS}]]"
OTHER = rf"[[^\p{{White_Space}}\p{{L}}\p{{N}}]||[{NEWER_LETTERS}{NEWER_NUMBERS}]]"

SPACE = r"\p{White_Space}"


# How byte-level vocabularies split text and write bytes as characters.
def byte_level(letter: str, number: str, other: str, space: str) -> str:
    return (
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+"
        rf"|{space}+(?!(?!{space})(?s:.))|{space}+"
    )


def word_level(letter: str, number: str, other: str, space: str) -> str:
    return rf"'s|'t|'re|'ve|'m|'ll|'d|{letter}+|{number}|{other}+"


PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def below_256(of_class: str) -> str:
    """The same class as a plain list of characters, for texts that have no others."""
    known = regex.compile(of_class, regex.VERSION1)
    return "[" + "".join(re.escape(chr(c)) for c in range(256) if known.fullmatch(chr(c))) + "]"


def is_narrow(text: str) -> bool:
    """Whether all code points are below 256; such texts are composed as they stand."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable, else one from 256 on."""
    rest = iter(range(256, 512))
    return [chr(b) if b in PRINTABLE else chr(next(rest)) for b in range(256)]


class Generations(dict):
    """A cache that drops what has not been asked for while ``limit`` other keys came in."""

    def __init__(self, make, limit: int = CACHED_WORDS):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class Vocabulary:
    """A tokenizer file: merge ranks by pairs of ids, and what to do before merging."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        model = parts["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        # Rank by the pair of ids, in one integer, and the id that each rank makes.
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault(self.ids[left] << 20 | self.ids[right], rank)
            self.made.append(self.ids[left + right])
        self.special = {t["content"]: t["id"] for t in parts["added_tokens"]}
        self.strings = [""] * (1 + max(*self.ids.values(), *self.special.values()))
        for string, place in (self.ids | self.special).items():
            self.strings[place] = string
        characters = byte_characters()
        self.inner = [self.ids[c] for c in characters]
        self.last = [self.ids[c + self.suffix] for c in characters]
        self.folds = parts["normalizer"] is not None
        split = word_level if self.folds else byte_level
        classes = (LETTER, NUMBER, OTHER, SPACE)
        self.pattern = regex.compile(split(*classes), regex.VERSION1)
        self.narrow = re.compile(split(*map(below_256, classes)))
        self.cut = regex.compile(
            "(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")"
        )
        self.marks = tuple(self.special)
        self.spaces = regex.compile(f"{SPACE}+")
        self.marked = regex.compile(f"([{NEWER_SIGNS}])")
        self.newer = regex.compile("[" + "".join(map(chr, NEWER_SMALL)) + "]")

    def symbols(self, word: str) -> list[int]:
        """Ids of the word's bytes before any merge; the last carries the word end."""
        data = word.encode("utf-8")
        return [self.inner[b] for b in data[:-1]] + [self.last[data[-1]]]

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens and special strings, in order; special strings stand for themselves."""
        if not any(mark in text for mark in self.marks):
            return self.words(text)
        found: list[str] = []
        for part in self.cut.split(text):
            found.extend([part] if part in self.special else self.words(part))
        return found

    def composed(self, text: str) -> str:
        if not self.marked.search(text):
            return unicodedata.normalize("NFC", text)
        return "".join(unicodedata.normalize("NFC", part) for part in self.marked.split(text))

    def words(self, text: str) -> list[str]:
        narrow = is_narrow(text)
        if self.folds and narrow:
            text = text.lower()
        elif self.folds:
            text = self.spaces.sub(" ", self.composed(text))
            # Character by character: a capital sigma has one small form wherever it stands.
            text = text.replace("Σ", "σ").lower()
            if self.newer.search(text):
                text = text.translate(NEWER_SMALL)
        return (self.narrow if narrow else self.pattern).findall(text)


def merged(symbols: list[int], vocab: Vocabulary) -> list[int]:
    """Symbols after all merges, lowest rank first and leftmost among equals."""
    symbols = list(symbols)
    _merge(symbols, vocab.ranks, vocab.made)
    return [s for s in symbols if s >= 0]


def merge_count(symbols: list[int], vocab: Vocabulary) -> int:
    """Number of merges only; no identifiers are put together."""
    return _merge(list(symbols), vocab.ranks, vocab.made)


def _merge(symbols: list[int], ranks: dict[int, int], made: list[int]) -> int:
    """Merges in place: a merged symbol takes its left place, the right one becomes -1.

    A queue entry is rank and place in one integer. It is stale if the pair that now begins at
    its place has another rank, or if there is none.
    """
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    queue = []
    left = -1
    for i, right in enumerate(symbols):
        if i and (rank := ranks.get(left << 20 | right)) is not None:
            queue.append(rank << 32 | i - 1)
        left = right
    heapify(queue)
    merges = 0
    while queue:
        entry = heappop(queue)
        rank, i = entry >> 32, entry & 0xFFFFFFFF
        j = after[i]
        if j >= n or symbols[i] < 0 or ranks.get(symbols[i] << 20 | symbols[j]) != rank:
            continue
        merges += 1
        new = made[rank]
        symbols[i], symbols[j] = new, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (rank := ranks.get(new << 20 | symbols[k])) is not None:
                heappush(queue, rank << 32 | i)
        h = before[i]
        if h >= 0 and (rank := ranks.get(symbols[h] << 20 | new)) is not None:
            heappush(queue, rank << 32 | h)
    return merges


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=4)
def _encoded_words(path: str, limit: int = CACHED_WORDS) -> Generations:
    vocab = vocabulary(path)

    def make(word: str) -> bytes:
        if word in vocab.special:
            ids = [vocab.special[word]]
        else:
            ids = merged(vocab.symbols(word), vocab)
        return np.array(ids, np.int32).tobytes()

    return Generations(make, limit)


@lru_cache(maxsize=4)
def _counted_words(path: str, limit: int = CACHED_WORDS) -> Generations:
    vocab = vocabulary(path)

    def make(word: str) -> int:
        if word in vocab.special:
            return 1
        symbols = vocab.symbols(word)
        return len(symbols) - merge_count(symbols, vocab)

    return Generations(make, limit)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds ``ids``, the token ids of ``text`` as the file at ``path`` defines them.

    Special strings inside a text become their id, none is added, nothing is truncated. The
    file must lie at ``path`` on every executor.
    """

    def compute():
        vocab, cache = vocabulary(path), _encoded_words(path)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            return [_id_lists(vocab, cache, texts_of(batch, text))]

        return work

    return append_columns(docs, [StructField(ids, ArrayType(IntegerType()))], compute)


def _id_lists(vocab: Vocabulary, cache: Generations, texts: list[str | None]) -> pa.ListArray:
    packed = [b"".join(map(cache.__getitem__, vocab.pieces(t))) if t else b"" for t in texts]
    return list_array(b"".join(packed), [len(p) // 4 for p in packed], pa.int32())


def decode(
    docs: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded", between: str = " "
) -> DataFrame:
    """Adds ``decoded``: the vocabulary strings of ``ids``, joined by ``between``.

    The word file has no decoder of its own, and its library then puts a space between
    tokens. For byte-level files use ``between=""`` and map characters to bytes with
    ``bytes_of``. Null ids decode to the empty string; an unknown id raises.
    """

    def compute():
        strings = vocabulary(path).strings

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            column = batch.column(batch.schema.get_field_index(ids))
            return [_decoded_texts(strings, column, between)]

        return work

    return append_columns(docs, [StructField(decoded, StringType())], compute)


def _decoded_texts(strings: list[str], column: pa.ListArray, between: str) -> pa.Array:
    rows = (between.join(map(strings.__getitem__, row or ())) for row in _rows(column))
    return pa.array(rows, pa.string())


def encode_and_decode(
    docs: DataFrame,
    path: str,
    text: str = "text",
    ids: str = "ids",
    decoded: str = "decoded",
    between: str = " ",
    cached_words: int = CACHED_WORDS,
) -> DataFrame:
    """``decode`` after ``encode``, in one pass through Python.

    ``cached_words`` trades memory of the Python workers (some 400 bytes each) for time.
    """

    def compute():
        vocab, cache = vocabulary(path), _encoded_words(path, cached_words)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            column = _id_lists(vocab, cache, texts_of(batch, text))
            return [column, _decoded_texts(vocab.strings, column, between)]

        return work

    fields = [
        StructField(ids, ArrayType(IntegerType())),
        StructField(decoded, StringType()),
    ]
    return append_columns(docs, fields, compute)


def _rows(column: pa.ListArray):
    flat = column.values.to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()
    for i in range(len(column)):
        yield flat[offsets[i] : offsets[i + 1]].tolist() if column[i].is_valid else None


def bytes_of(string: str) -> bytes:
    """Bytes that a byte-level vocabulary string stands for."""
    place = {c: b for b, c in enumerate(byte_characters())}
    return bytes(place[c] for c in string)


def count_tokens(
    docs: DataFrame,
    path: str,
    text: str = "text",
    n_tokens: str = "n_tokens",
    cached_words: int = CACHED_WORDS,
) -> DataFrame:
    """Adds ``n_tokens``: symbols before merging less merges, with no ids made.

    ``cached_words`` trades memory of the Python workers (some 300 bytes each) for time.
    """

    def compute():
        vocab, cache = vocabulary(path), _counted_words(path, cached_words)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            return [
                pa.array(
                    [
                        sum(map(cache.__getitem__, vocab.pieces(t))) if t else 0
                        for t in texts_of(batch, text)
                    ],
                    pa.int64(),
                )
            ]

        return work

    return append_columns(docs, [StructField(n_tokens, LongType())], compute)
