"""Language identification by compression.

Each language is a zstandard raw-content dictionary: plain text of that language which a
compressor may refer back to. A text is coded in pieces against every dictionary, and the
language whose dictionary makes it smallest is chosen. Sizes are whole bytes, so the languages
of a few words often tie: where the best two are within ``NARROW`` bytes, the pieces are coded
again after each of ``CONTEXTS`` passages of the language, and the sums decide. Where the best
two are still close, the text is rejected.

Fitting reads the language column only of the rows it is given and takes a bounded sample of
them: ``SLICES`` slices of the rows by hash, ``PER_SLICE`` rows each, ``SAMPLE_CHARS``
characters each, per language. Prediction reads nothing but the text.

A null text, or one without letters (Unicode's L), is ``und`` with score 0 and rejected. Rows without
language are not learned from; with no such row at all every text is ``und``. Columns of the
results' names are replaced, others pass through, repeated rows and empty tables stay as they
are. Ties go to the language that sorts first.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField

from corpusflow.llm.frames import append_columns, texts_of

UNKNOWN = "und"
SLICES = 64
PER_SLICE = 6
SAMPLE_CHARS = 1500
PIECE = 1024
LEVEL = 6
NARROW, CONTEXTS, CONTEXT_BYTES = 8, 32, 300
# Least saving of the best language over the next one, as a share of the latter's size.
MIN_MARGIN = 0.001

_NOT_LETTERS = re.compile(r"[\W\d_]+")
_LETTER = regex.compile(r"\p{L}")


def letters(text: str) -> str:
    """Lower-case words only: what the languages differ in."""
    return _NOT_LETTERS.sub(" ", text.lower()).strip()


def fit(rows: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Dictionary content per language, learned from a bounded sample of ``rows``.

    The sample is chosen by a hash of the text, so it does not depend on partitions; every
    slice of a language is cut to its few rows before the shuffle. What reaches the driver is
    at most ``SLICES * PER_SLICE * SAMPLE_CHARS`` characters per language.
    """
    draw = F.xxhash64(F.col(text))
    length = F.length(text)
    place = F.pmod(draw, F.greatest(length - SAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1
    known = rows.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(lang).alias("_lang"),
        draw.alias("_draw"),
        F.pmod(draw, F.lit(SLICES)).alias("_slice"),
        F.substring(F.col(text), place, F.lit(SAMPLE_CHARS)).alias("_sample"),
    )
    order = Window.partitionBy("_lang", "_slice").orderBy("_draw", "_sample")
    chosen = known.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= PER_SLICE)
    samples: dict[str, list[tuple[int, str]]] = {}
    for row in chosen.select("_lang", "_draw", "_sample").collect():
        samples.setdefault(row["_lang"], []).append((row["_draw"], letters(row["_sample"])))
    return {
        name: "\n".join(sample for _, sample in sorted(samples[name])).encode("utf-8")
        for name in sorted(samples)
    }


@dataclass
class Coder:
    """A language's compressor, passages that its dictionary does not hold, and their sizes."""

    name: str
    compress: Callable[[bytes], bytes]
    contexts: list[bytes]
    alone: int


@lru_cache(maxsize=2)
def _coders(content: tuple[tuple[str, bytes], ...]) -> list[Coder]:
    made = []
    for name, data in content:
        words = data.split()
        share = -(-len(words) // CONTEXTS) or 1
        rest, contexts = [], []
        for start in range(0, len(words), share):
            part = words[start : start + share]
            size = 0
            passage: list[bytes] = []
            while len(part) > 1 and len(passage) < share // 4 and size < CONTEXT_BYTES:
                passage.append(part.pop())
                size += len(passage[-1]) + 1
            contexts.append(b" ".join([*passage, b""]))
            rest += part
        # Eight bytes at least: shorter contents are no dictionary.
        dictionary = zstandard.ZstdCompressionDict(
            b" ".join(rest).ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT
        )
        dictionary.precompute_compress(level=LEVEL)
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary).compress
        contexts = (contexts or [b""]) * CONTEXTS
        alone = sum(len(compress(c)) for c in contexts[:CONTEXTS])
        made.append(Coder(name, compress, contexts[:CONTEXTS], alone))
    return made


def sizes(text: str, content: tuple[tuple[str, bytes], ...]) -> list[tuple[float, str]]:
    """Compressed size and name of every language, smallest first; ties by name.

    Sizes of texts coded in contexts are means, and the smallest is at least one byte.
    """
    data = letters(text).encode("utf-8")
    pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
    coders = _coders(content)
    found = sorted((sum(len(c.compress(p)) for p in pieces), c.name) for c in coders)
    if len(found) < 2 or found[1][0] - found[0][0] > NARROW:
        return found

    def in_contexts(c: Coder) -> float:
        total = sum(len(c.compress(x + p + b" ")) for p in pieces for x in c.contexts)
        return (total - len(pieces) * c.alone) / CONTEXTS

    means = sorted((in_contexts(c), c.name) for c in coders)
    if means[1][0] > 1.0:
        return [(max(size, 1.0), name) for size, name in means]
    # The best two take a byte at most: raised alike, as a floor for each would make them equal.
    return [(size + 1.0 - means[0][0], name) for size, name in means]


def identify(
    docs: DataFrame,
    content: dict[str, bytes],
    text: str = "text",
    predicted: str = "lang_pred",
    score: str = "score",
    rejected: str = "rejected",
    min_margin: float = MIN_MARGIN,
) -> DataFrame:
    """Adds the predicted language, its margin as ``score`` (0 to 1) and ``rejected``.

    The score is the saving of the best language over the second, as a share of the second's
    size; with one language it is 1. Texts with a score below ``min_margin`` are rejected.
    """
    fixed = tuple(sorted(content.items()))

    def guess(value: str | None) -> tuple[str, float, bool]:
        if not value or not fixed or not _LETTER.search(value):
            return UNKNOWN, 0.0, True
        ranked = sizes(value, fixed)
        best, name = ranked[0]
        margin = 1.0 if len(ranked) == 1 else 1 - best / ranked[1][0]
        return name, margin, margin < min_margin

    def compute():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            found = [guess(value) for value in texts_of(batch, text)]
            return [
                pa.array([f[0] for f in found], pa.string()),
                pa.array([f[1] for f in found], pa.float64()),
                pa.array([f[2] for f in found], pa.bool_()),
            ]

        return work

    fields = [
        StructField(predicted, StringType()),
        StructField(score, DoubleType()),
        StructField(rejected, BooleanType()),
    ]
    return append_columns(docs, fields, compute)


def held_out(doc_id: str = "doc_id"):
    """Rows kept from learning: a quarter by the checksum of the id (a null id is none)."""
    remainder = F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4))
    return F.coalesce(remainder == 2, F.lit(False))
