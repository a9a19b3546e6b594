"""Quality classifier from weak labels.

1. Heuristic labellers vote on every text: bad, good or nothing.
2. Texts with the same votes are counted: at most ``3 ** labellers`` rows, however many texts
   there are. On that table expectation-maximisation estimates how often each labeller casts
   each vote on good and on bad texts, and from that the chance that a text is bad.
3. A linear scorer learns these chances from hashed features of a bounded sample: per class
   ``SLICES`` slices of the texts by hash, ``PER_SLICE`` texts each.
4. The scorer is applied to every whole text.

Labels of any table are not read; they serve to check results. A null or empty text, or one
without words, has score 0 and is not kept. Rows with a null id are scored but not learned from.
With no rows to learn from every text with words scores by the intercept alone. Columns of the
results' names are replaced, others pass through, repeated rows and empty tables stay.
"""

from __future__ import annotations

import re
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType
from pyspark.sql.types import LongType, StructField

from corpusflow.functions.lineage import shared_folder
from corpusflow.llm.bpe import CACHED_HASHES, Generations
from corpusflow.llm.frames import append_columns, texts_of

NOTHING, GOOD, BAD = 0, 1, 2
SLICES, PER_SLICE = 64, 40
FEATURES = 1 << 14
ROUNDS = 200
FEW_WORDS = 10
# Classes weigh the same in learning; a text goes only at odds of about 30 to 1 against it.
KEEP = 0.03

_SYMBOLS = re.compile(r"[#%&*$|~^<>{}\\=_]")


def _vote(value: float, good: float, bad: float) -> int:
    """Bad from ``bad`` on, good up to ``good``, nothing between."""
    return BAD if value >= bad else GOOD if value <= good else NOTHING


_PLAIN = re.compile(r"[\"'(]?[^\W\d_]+(?:['’-][^\W\d_]+)*[\"')]?[.,;:!?]?")
_MARKS = re.compile(r"[^\w\s]")


def _plain(word: str) -> bool:
    return _PLAIN.fullmatch(word) is not None


@lru_cache(maxsize=1)
def _plain_words() -> Generations:
    return Generations(_plain, CACHED_HASHES)


def votes(text: str) -> list[int]:
    """Votes of all labellers on a text with words.

    They overlap: odd symbols show in the first three, shouting in the second to the fifth,
    repetition in the last four.
    """
    words = text.split()
    n, size = len(words), len(text)
    lines = [line for line in text.split("\n") if line]
    stops = (text.count(".") + text.count("?") + text.count("!")) / n
    return [
        _vote(len(_SYMBOLS.findall(text)) / size, 0.005, 0.03),
        _vote(1 - sum(map(_plain_words().__getitem__, words)) / n, 0.1, 0.25),
        NOTHING if n < 20 else _vote(len(_MARKS.findall(text)) / size, 0.06, 0.09),
        _vote(sum(map(str.isupper, words)) / n, 0.1, 0.3),
        _vote(text.count("!") / n, 0.05, 0.3),
        _vote(sum(map(str.__eq__, words, words[1:])) / n, 0.1, 0.2),
        NOTHING if n < 50 else _vote(1 - len(set(words)) / n, 0.5, 0.75),
        NOTHING if len(lines) < 4 else _vote(1 - len(set(lines)) / len(lines), 0.1, 0.4),
        NOTHING if n < 20 else BAD if stops < 0.005 else GOOD if stops < 0.4 else BAD,
    ]


LABELLERS = 9


def coded(found: list[int]) -> int:
    code = 0
    for vote in found:
        code = code * 3 + vote
    return code


def decoded(codes: np.ndarray) -> np.ndarray:
    powers = 3 ** np.arange(LABELLERS - 1, -1, -1)
    return codes[:, None] // powers % 3


def expectation_maximisation(
    patterns: np.ndarray, counts: np.ndarray, rounds: int = 100
) -> tuple[np.ndarray, np.ndarray]:
    """Chance of being bad per pattern of votes, and each labeller's rates of its votes.

    Rates are indexed by class (good, bad), labeller and vote. Votes count as independent
    given the class. It starts from: bad where any labeller says so.
    """
    bad = np.where((patterns == BAD).any(axis=1), 0.9, 0.05)
    shape = (2, patterns.shape[1], 3)
    rates = np.full(shape, 1 / 3)
    seen = patterns[:, :, None] == np.arange(3)
    for _ in range(rounds):
        weights = counts * np.stack([1 - bad, bad])
        rates = np.einsum("cp,plv->clv", weights, seen) + 0.1
        rates /= rates.sum(axis=2, keepdims=True)
        prior = (weights.sum(axis=1) + 1) / (weights.sum() + 2)
        logs = np.log(prior)[:, None] + np.einsum("clv,plv->cp", np.log(rates), seen)
        bad = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
    return bad, rates


_RUN = re.compile(r"(.)\1+")


def _shape(word: str) -> int:
    """Feature of a word's make-up: classes of its characters, runs shortened."""
    classes = "".join(
        "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in word
    )
    return zlib.crc32(_RUN.sub(r"\1\1", classes).encode("utf-8", "replace"))


@lru_cache(maxsize=1)
def _shapes() -> Generations:
    return Generations(_shape, CACHED_HASHES)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed places and values: shapes of words, of pairs, and words and lines seen before."""
    words = text.split()
    n = len(words)
    shapes = np.fromiter(map(_shapes().__getitem__, words), np.int64, n)
    pairs = (shapes[:-1] * 31 + shapes[1:] * 17 + 7) & 0xFFFFFFFF
    places, counts = np.unique(np.concatenate([shapes, pairs]) % (FEATURES - 4), return_counts=True)
    lines = [line for line in text.split("\n") if line]
    repeats = sum(map(str.__eq__, words, words[1:])) / n
    extra = [repeats, 1 - len(set(words)) / n, 1 - len(set(lines)) / max(1, len(lines)), 1.0]
    values = np.sqrt(counts / n)
    # A text of few words says little: its evidence shrinks towards undecided.
    trust = n / (n + FEW_WORDS)
    return (
        np.concatenate([places, np.arange(FEATURES - 4, FEATURES)]).astype(np.int32),
        (trust * np.concatenate([values, extra])).astype(np.float32),
    )


def with_votes(docs: DataFrame, text: str, code: str) -> DataFrame:
    def compute():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            rows = [
                coded(votes(t)) if t and not t.isspace() else None for t in texts_of(batch, text)
            ]
            return [pa.array(rows, pa.int32())]

        return work

    return append_columns(docs, [StructField(code, IntegerType())], compute, drop=(text,))


def with_features(docs: DataFrame, text: str) -> DataFrame:
    def compute():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            rows = [features(t) for t in texts_of(batch, text)]
            return [
                pa.array([r[0] for r in rows], pa.list_(pa.int32())),
                pa.array([r[1] for r in rows], pa.list_(pa.float32())),
            ]

        return work

    fields = [
        StructField("_places", ArrayType(IntegerType())),
        StructField("_values", ArrayType(FloatType())),
    ]
    return append_columns(docs, fields, compute, drop=(text,))


def fit(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> np.ndarray:
    """Weights of the linear scorer, learned from ``docs`` without labels.

    Votes of all texts are stored as narrow rows in the shared folder, so texts are read once
    for votes and only the sampled ones again for features. What reaches the driver: a row per
    pattern of votes, and the sample.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/quality-{uuid.uuid4().hex}"
    key = F.col(doc_id).cast("long").alias("_id")
    rows = docs.select(key, F.col(text).alias("_text"))
    drawn = rows.where(F.col("_id").isNotNull()).withColumn("_draw", F.xxhash64("_text", "_id"))
    with_votes(drawn, "_text", "_code").where(F.col("_code").isNotNull()).write.parquet(folder)
    voted = spark.read.parquet(folder)
    table = sorted(map(tuple, voted.groupBy("_code").count().collect()))
    if not table:
        return np.zeros(FEATURES)
    codes, counts = (np.array(c, np.int64) for c in zip(*table, strict=True))
    bad, _ = expectation_maximisation(decoded(codes), counts)
    chances = spark.createDataFrame(
        list(zip(codes.tolist(), bad.tolist(), strict=True)), "_code int, _bad double"
    )
    slices = Window.partitionBy("_class", "_slice").orderBy("_draw", "_id")
    chosen = (
        voted.join(F.broadcast(chances), "_code")
        .select(
            "_id",
            "_bad",
            "_draw",
            (F.col("_bad") > 0.5).alias("_class"),
            F.pmod("_draw", F.lit(SLICES)).alias("_slice"),
        )
        .withColumn("_n", F.row_number().over(slices))
        .where(F.col("_n") <= PER_SLICE)
        .select("_id", "_bad", "_draw")
    )
    texts = rows.join(F.broadcast(chosen), "_id").where(
        F.xxhash64("_text", "_id") == F.col("_draw")
    )
    sample = with_features(texts, "_text").orderBy("_draw", "_id").toArrow()
    return logistic(
        sample.column("_places").to_pylist(),
        sample.column("_values").to_pylist(),
        np.array(sample.column("_bad").to_pylist()),
    )


def logistic(places: list, values: list, bad: np.ndarray, rate: float = 1.0) -> np.ndarray:
    """Weights by full gradient steps on chances instead of labels; both classes weigh the same."""
    lengths = [len(p) for p in places]
    row = np.repeat(np.arange(len(places)), lengths)
    place = np.concatenate([np.asarray(p, np.int64) for p in places])
    value = np.concatenate([np.asarray(v, np.float64) for v in values])
    weigh = bad / max(bad.sum(), 1e-9) + (1 - bad) / max((1 - bad).sum(), 1e-9)
    weigh /= weigh.sum()
    weights, squares = np.zeros(FEATURES), np.full(FEATURES, 1e-8)
    for _ in range(ROUNDS):
        margin = np.bincount(row, weights[place] * value, len(places))
        error = (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - bad) * weigh
        slope = np.bincount(place, error[row] * value, FEATURES) + 1e-6 * weights
        squares += slope**2
        weights -= rate * slope / np.sqrt(squares)
    return weights


def score(
    docs: DataFrame,
    weights: np.ndarray,
    text: str = "text",
    quality: str = "quality_score",
    kept: str = "kept",
    n_words: str = "n_words",
    keep: float = KEEP,
) -> DataFrame:
    """Adds the chance that a text is good, whether it is kept, and its number of words."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def compute():
        own = shared.value

        def one(value: str | None) -> tuple[float, int]:
            if not value or value.isspace():
                return 0.0, 0
            places, values = features(value)
            margin = float(own[places] @ values)
            return 1 / (1 + float(np.exp(np.clip(margin, -50, 50)))), len(value.split())

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            rows = [one(value) for value in texts_of(batch, text)]
            return [
                pa.array([r[0] for r in rows], pa.float64()),
                pa.array([bool(r[1]) and r[0] >= keep for r in rows], pa.bool_()),
                pa.array([r[1] for r in rows], pa.int64()),
            ]

        return work

    fields = [
        StructField(quality, DoubleType()),
        StructField(kept, BooleanType()),
        StructField(n_words, LongType()),
    ]
    return append_columns(docs, fields, compute)
