"""Cosine top-k over Arrow batches.

Spark partitions the vectors and moves the rows; these helpers score what one task holds
with matrix products of bounded size and keep the best ``k`` per query, so a task never holds or
emits more than ``k`` rows per query it has seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Queries and documents of one matrix product (8 MB of floats), the candidates scored at once, and
# those that may wait for the next cut to the best.
_QUERY_ROWS, _DOC_ROWS = 1024, 2048
_CANDIDATES = 1 << 13
_PENDING = 1 << 16
# A product's rows are cut into groups of so many documents to bound the best of a row from below.
_GROUP = 16

MATCH_SCHEMA = "query_id bigint, id bigint, similarity double"


def unit_rows(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and unit vectors of the usable rows.

    NULL and zero vectors are left out, vectors of another size are an error.
    """
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    positions = np.flatnonzero(pc.is_valid(vectors).to_numpy(zero_copy_only=False))
    if vectors.null_count:
        vectors = vectors.take(pa.array(positions))
    sizes = pc.list_value_length(vectors)
    if len(vectors) and not pc.all(pc.equal(sizes, dim)).as_py():
        raise ValueError(f"expected vectors of {dim} dimensions")
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = flat.reshape(-1, dim)
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    usable = norms > 0
    if not usable.all():
        positions, matrix, norms = positions[usable], matrix[usable], norms[usable]
    matrix /= norms[:, None]
    return positions, matrix


def identified(
    ids: pa.Array, vectors: pa.Array, dim: int
) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of the usable rows."""
    positions, matrix = unit_rows(vectors, dim)
    return np.asarray(ids)[positions], matrix


class TopK:
    """Best ``k`` documents per query over the documents added so far.

    Queries are taken in parts of ``_QUERY_ROWS``. Besides the vectors themselves this holds at
    most ``k`` rows per query, and what one matrix product and one part of queries need.
    """

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int, threshold: float):
        self.query_ids, self.queries = query_ids, queries
        self.k, self.threshold = k, threshold
        # Candidates come from products of floats, with slack for their rounding, and are then
        # scored row-wise in doubles.
        self.narrow = queries.astype(np.float32)
        self.slack = (queries.shape[1] + 8) * 2.0**-23
        self.floor = np.full(len(query_ids), threshold, dtype=np.float64)
        self.kept: dict[int, list[np.ndarray]] = {}

    def add(self, ids: np.ndarray, docs: np.ndarray, only: np.ndarray | None = None) -> None:
        """Score documents against all queries, or against those at the places ``only``."""
        if not len(ids) or self.k < 1:
            return
        narrow = docs.astype(np.float32)
        for part, first in enumerate(range(0, len(self.query_ids), _QUERY_ROWS)):
            places = np.arange(first, min(first + _QUERY_ROWS, len(self.query_ids)))
            if only is not None:
                places = only[(only >= first) & (only < first + _QUERY_ROWS)]
            if len(places):
                self._add(part, places, ids, docs, narrow)

    def _add(
        self, part: int, places: np.ndarray, ids: np.ndarray, docs: np.ndarray, narrow: np.ndarray
    ) -> None:
        queries = self.narrow[places]
        pending: list[list[np.ndarray]] = []
        n_pending = 0
        for low in range(0, len(ids), _DOC_ROWS):
            products = queries @ narrow[low : low + _DOC_ROWS].T
            hits = products >= self._least(places)
            if np.count_nonzero(hits) > 2 * self.k * len(places):
                self._raise_floor(places, products)
                hits = products >= self._least(places)
            found = np.flatnonzero(hits)
            width = products.shape[1]
            for start in range(0, len(found), _CANDIDATES):
                which, rows = np.divmod(found[start : start + _CANDIDATES], width)
                cols, rows = places[which], rows + low
                scores = np.einsum("ij,ij->i", docs[rows], self.queries[cols])
                above = scores > self.threshold
                pending.append([cols[above], ids[rows[above]], scores[above]])
                n_pending += int(above.sum())
                if n_pending > max(_PENDING, 4 * self.k * len(places)):
                    self._prune(part, pending)
                    pending, n_pending = [], 0
        if n_pending:
            self._prune(part, pending)

    def _least(self, places: np.ndarray) -> np.ndarray:
        return (self.floor[places] - self.slack).astype(np.float32)[:, None]

    def _raise_floor(self, places: np.ndarray, products: np.ndarray) -> None:
        """Raise what a document must reach: ``k`` groups have a document as good as the k-th best group."""
        n_groups = products.shape[1] // _GROUP
        if n_groups < self.k:
            return
        grouped = products[:, : _GROUP * n_groups].reshape(len(places), _GROUP, n_groups)
        best = grouped.max(axis=1)
        if np.isfinite(best).all():
            best.partition(n_groups - self.k, axis=1)
            reached = best[:, n_groups - self.k].astype(np.float64) - self.slack
            self.floor[places] = np.maximum(self.floor[places], reached)

    def _prune(self, part: int, pending: list[list[np.ndarray]]) -> None:
        parts = [self.kept[part], *pending] if part in self.kept else pending
        cols, ids, scores = (np.concatenate(columns) for columns in zip(*parts, strict=True))
        order = np.lexsort((ids, -scores, cols))
        cols, ids, scores = cols[order], ids[order], scores[order]
        starts = np.flatnonzero(np.r_[True, cols[1:] != cols[:-1]]) if len(cols) else cols
        rank = np.arange(len(cols)) - np.repeat(starts, np.diff(np.r_[starts, len(cols)]))
        last = rank == self.k - 1
        self.floor[cols[last]] = np.maximum(self.floor[cols[last]], scores[last])
        best = rank < self.k
        self.kept[part] = [cols[best], ids[best], scores[best]]

    def result(self) -> pa.RecordBatch:
        none = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float64)]
        found = [none, *(self.kept[part] for part in sorted(self.kept))]
        cols, ids, scores = (np.concatenate(columns) for columns in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(self.query_ids[cols].astype(np.int64)),
                pa.array(ids.astype(np.int64)),
                pa.array(scores),
            ],
            names=["query_id", "id", "similarity"],
        )


def score_batches(
    batches: Iterator[pa.RecordBatch],
    query_ids: np.ndarray,
    queries: np.ndarray,
    k: int,
    threshold: float,
) -> Iterator[pa.RecordBatch]:
    """Top-k of one partition of ``(id, embedding)`` batches."""
    best = TopK(query_ids, queries, k, threshold)
    for batch in batches:
        best.add(*identified(batch.column(0), batch.column(1), queries.shape[1]))
    yield best.result()


def nearest(
    vectors: np.ndarray, centroids: np.ndarray, n: int
) -> np.ndarray:
    """Indexes of the ``n`` most similar centroids per row, best first."""
    scores = vectors @ centroids.T
    n = min(n, centroids.shape[0])
    return np.argsort(-scores, axis=1, kind="stable")[:, :n]
