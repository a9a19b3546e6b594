"""Embedding job: a user's model over chunks, in batches, with per-row errors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow import config

# Pages whose chunks are embedded in one sequence of calls.
PAGE_BLOCK = 4096

Embedder = Callable[[list[str]], list[list[float]]]


def embed_chunks(
    chunks: DataFrame,
    embedder: Embedder,
    batch_size: int = config.EMBED_BATCH,
    text_column: str = "content",
) -> DataFrame:
    """Add ``embedding`` and ``error``.

    Texts are sent to ``embedder`` in calls of ``batch_size``, in corpus order. Which rows
    share a call follows from their keys alone: calls begin anew every ``PAGE_BLOCK`` pages,
    so partitions, retries and other pages change nothing. A call that raises, or that returns
    a different number of vectors, marks the rows of that batch and the job goes on.
    """
    def call(texts: list[str]) -> tuple[list, list]:
        try:
            vectors = embedder(texts)
            if len(vectors) != len(texts):
                raise ValueError(f"Expected {len(texts)} embeddings, got {len(vectors)}")
            return [np.asarray(v, dtype=np.float32) for v in vectors], [None] * len(texts)
        except Exception as failure:  # noqa: BLE001 - any failure of the user's model
            return [None] * len(texts), [str(failure) or type(failure).__name__] * len(texts)

    def embed(rows: pd.DataFrame) -> pd.DataFrame:
        texts = rows[text_column].tolist()
        embeddings, errors = [], []
        for low in range(0, len(texts), batch_size):
            vectors, failures = call(texts[low:low + batch_size])
            embeddings += vectors
            errors += failures
        return rows.assign(
            embedding=pd.Series(embeddings, index=rows.index, dtype=object),
            error=pd.Series(errors, index=rows.index, dtype=object),
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Calls are full batches across Arrow batches; the last rows wait for the next.
        rest: pd.DataFrame | None = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            blocks = rows["_block"].to_numpy()
            starts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1), len(rows)]
            for low, high in zip(starts, starts[1:], strict=False):
                open_end = (high - low) % batch_size if high == len(rows) else 0
                if high - open_end > low:
                    yield embed(rows.iloc[low:high - open_end].drop(columns="_block"))
                rest = rows.iloc[high - open_end:]
        if rest is not None and len(rest):
            yield embed(rest.drop(columns="_block"))

    schema = T.StructType(
        [
            *chunks.schema.fields,
            T.StructField("embedding", T.ArrayType(T.FloatType())),
            T.StructField("error", T.StringType()),
        ]
    )
    return (
        chunks.withColumn("_block", F.floor(F.col("page_ord") / PAGE_BLOCK))
        .repartition("_block")
        .sortWithinPartitions("_block", "page_ord", "section_index", "chunk_index")
        .mapInPandas(run, schema)
    )


def hashing_embedder(dim: int = 64) -> Embedder:
    """Deterministic word-hashing vectors, for tests and dry runs."""
    import zlib

    def embed(texts: list[str]) -> list[list[float]]:
        vectors = np.zeros((len(texts), dim))
        for row, text in enumerate(texts):
            for word in text.lower().split():
                digest = zlib.crc32(word.encode())
                vectors[row, digest % dim] += 1.0 if digest & 0x80000000 else -1.0
        return vectors.tolist()

    return embed


def embed_summary(embedded: DataFrame) -> DataFrame:
    """One row: processed, succeeded and failed chunks."""
    failed = F.col("error").isNotNull()
    return embedded.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~failed).alias("succeeded"),
        F.count_if(failed).alias("failed"),
    )


def first_errors(embedded: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` failed chunks in corpus order."""
    return (
        embedded.where(F.col("error").isNotNull())
        .orderBy("page_ord", "section_index", "chunk_index")
        .limit(n)
        .select("id", "error")
    )
