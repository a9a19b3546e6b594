"""Arrow helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

# Rows of an Arrow batch between Spark and Python, where the session allows more: texts are long.
BATCH_ROWS = 1000

Compute = Callable[[pa.RecordBatch], list[pa.Array]]


def without(df: DataFrame, names: list[str]) -> list[str]:
    """Columns of ``df`` but for ``names``; names are compared like Spark does, without case."""
    taken = {name.lower() for name in names}
    return [name for name in df.columns if name.lower() not in taken]


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Names beginning with ``stems`` that no column of ``df`` has, for columns of passage."""
    taken = {name.lower() for name in df.columns}
    names = []
    for stem in stems:
        tries = (f"_{stem}{'_' * n}" for n in range(len(taken) + 1))
        names.append(next(name for name in tries if name.lower() not in taken))
        taken.add(names[-1].lower())
    return names


def append_columns(
    df: DataFrame,
    fields: list[StructField],
    compute: Callable[[], Compute],
    drop: tuple[str, ...] = (),
    rows: int = 512,
) -> DataFrame:
    """``df`` with further columns made from Arrow batches of ``rows`` rows at most.

    ``compute()`` runs once per task and returns the function from a batch to its new arrays.
    A column of ``df`` with the name of a new one is replaced; those in ``drop`` end here.
    Nothing is shuffled, and memory follows a batch, not a partition.
    """
    conf, setting = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(setting)) <= BATCH_ROWS:
        conf.set(setting, str(BATCH_ROWS))
    kept = without(df, [f.name for f in fields] + list(drop))
    out = StructType([df.schema[name] for name in kept] + fields)
    names = kept + [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = compute()
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                piece = batch.slice(start, rows)
                old = [piece.column(piece.schema.get_field_index(name)) for name in kept]
                yield pa.RecordBatch.from_arrays(old + work(piece), names)
        pa.default_memory_pool().release_unused()  # the worker lives on between tasks

    return df.mapInArrow(run, out)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str | None]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def list_array(values: bytes, lengths: list[int], kind: pa.DataType) -> pa.Array:
    """Lists over one packed buffer; ``lengths`` counts values per row."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    flat = pa.Array.from_buffers(kind, int(offsets[-1]), [None, pa.py_buffer(values)])
    return pa.ListArray.from_arrays(pa.array(offsets), flat)
