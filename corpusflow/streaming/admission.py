"""Request admission: client keys, rate limiting in batch and on a stream, timings.

A client's window opens with its first request and lasts a fixed time; the first request
after it (strictly later than its end) opens the next one. Requests beyond the limit are
denied and change nothing.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from corpusflow import config
from corpusflow.functions import text as t
from corpusflow.functions.lineage import stored

# The process that prepares a stateful operator on the driver does not see shipped packages.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_MICROS = 1_000_000
# Before the first request: a window that ended long ago, without requests.
_CLOSED = (-(2**62), 0)


def client_key(forwarded_for: Column, real_ip: Column, cdn_ip: Column) -> Column:
    """First forwarded address, else the real-ip header, else the CDN header.

    A forwarded-for header that is present but starts with a comma gives an empty key.
    """
    blank = F.lit("")
    first = F.when(
        F.nullif(forwarded_for, blank).isNotNull(), t.trim_ws(F.split(forwarded_for, ",")[0])
    )
    return F.coalesce(
        first, F.nullif(real_ip, blank), F.nullif(cdn_ip, blank), F.lit("unknown")
    )


def with_client_key(requests: DataFrame) -> DataFrame:
    """Add ``client`` to ``requests(request_id, ts, xff, real_ip, cdn_ip)``."""
    return requests.withColumn(
        "client", client_key(F.col("xff"), F.col("real_ip"), F.col("cdn_ip"))
    )


def rate_limit(
    requests: DataFrame,
    limit: int = config.RATE_LIMIT_REQUESTS,
    window_seconds: int = config.RATE_LIMIT_WINDOW_SECONDS,
    busy_rows: int = 1_000_000,
    segment_rows: int = 1_000_000,
) -> DataFrame:
    """Admission decision for every row of ``requests(request_id, client, ts)``.

    Returns ``(request_id, client, ts, allowed, remaining, reset_at, retry_after)``, the
    requests of a client taken in the order of ``(ts, request_id)``.

    A client with at most ``busy_rows`` requests is one group. The requests of the few above
    that are put in order by range and cut by count into segments of at most ``segment_rows``, so
    that a burst within one window is cut as well. Windows chain (each opens where the one
    before has ended), but how a segment maps the window open at its start to the one open
    at its end can be computed without knowing the start:

    1. per client and segment, the possible outcomes as a function of the entry state. Only
       ends of windows that the client can have opened before count: there is one for the
       first segment, and none that matters for segments within the first window;
    2. per client, the entry state of each segment, one pass over those outcomes;
    3. per client and segment, the decisions.
    """
    window = window_seconds * _MICROS
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    timed = requests.select("request_id", "client", us.alias("us"))
    # At most one client per busy_rows requests.
    busy = F.broadcast(
        timed.groupBy("client")
        .agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("first_us"))
        .where(F.col("n") > busy_rows)
        .select(F.col("client").alias("busy_client"), "first_us")
    )
    client_type = requests.schema["client"].dataType.simpleString()
    decided_type = f"request_id bigint, client {client_type}, us bigint, rank bigint, window_end bigint"
    if busy.isEmpty():
        alone = timed.groupBy("client").applyInArrow(
            lambda rows: _decided(rows, _CLOSED, window), decided_type
        )
        return _decisions(alone, limit)
    # A NULL client is one, too.
    same = F.col("client").eqNullSafe(F.col("busy_client"))
    columns = ["request_id", "client", "us", "first_us"]
    segmented = stored(_in_segments(timed.join(busy, same).select(*columns), segment_rows))

    def outcomes(key: tuple, rows: pa.Table) -> pa.Table:
        times, first = rows.column("us").to_numpy(), rows.column("first_us")[0].as_py()
        result = _segment_outcomes(times, first, window)
        n = len(result["below"])
        return pa.table({"client": pa.repeat(key[0], n), "segment": pa.repeat(key[1], n), **result})

    entry_schema = f"client {client_type}, segment bigint, open_end bigint, open_count bigint"
    entries = (
        segmented.select("client", "segment", "us", "first_us")
        .groupBy("client", "segment")
        .applyInArrow(
            outcomes,
            f"client {client_type}, segment bigint, below bigint, exit_end bigint, "
            "exit_count bigint, n_rows bigint",
        )
        .repartition("client")
        .sortWithinPartitions("client", "segment", "below")
        .mapInPandas(_chain_segments, entry_schema)
    )
    others = timed.join(busy, same, "left_anti").withColumn("segment", F.lit(-1).cast("long"))
    keyed = others.unionByName(segmented.select("request_id", "client", "us", "segment"))

    def decide(rows: pa.Table, entry: pa.Table) -> pa.Table:
        state = (
            (entry.column("open_end")[0].as_py(), entry.column("open_count")[0].as_py())
            if entry.num_rows
            else _CLOSED
        )
        return _decided(rows, state, window)

    decided = (
        keyed.groupBy("client", "segment")
        .cogroup(entries.groupBy("client", "segment"))
        .applyInArrow(decide, decided_type)
    )
    return _decisions(decided, limit)


def _decided(rows: pa.Table, state: tuple[int, int], window: int) -> pa.Table:
    ids, times = rows.column("request_id").to_numpy(), rows.column("us").to_numpy()
    order, rank, ends = _decide(ids, times, state, window)
    return pa.table(
        {
            "request_id": ids[order],
            "client": rows.column("client").take(pa.array(order)),
            "us": times[order],
            "rank": rank,
            "window_end": ends,
        }
    )


def _decisions(decided: DataFrame, limit: int) -> DataFrame:
    allowed = F.col("rank") <= limit
    wait = F.ceil((F.col("window_end") - F.col("us")) / F.lit(float(_MICROS)))
    return decided.select(
        "request_id",
        "client",
        F.timestamp_micros("us").alias("ts"),
        allowed.alias("allowed"),
        F.greatest(F.lit(limit) - F.col("rank"), F.lit(0)).alias("remaining"),
        F.timestamp_micros("window_end").alias("reset_at"),
        F.when(~allowed, wait).alias("retry_after"),
    )


def _in_segments(rows: DataFrame, segment_rows: int) -> DataFrame:
    """``rows(request_id, client, us, ...)`` with ``segment``.

    Rows are in order of ``(client, us, request_id)`` over ranges; a segment is at most
    ``segment_rows`` rows in a row, and begins anew with every range.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            place = np.arange(done, done + batch.num_rows) // segment_rows
            done += batch.num_rows
            yield batch.append_column("segment", pa.array(partition << 32 | place))

    in_order = ["client", "us", "request_id"]
    ranged = rows.repartitionByRange(*in_order).sortWithinPartitions(*in_order)
    return ranged.mapInArrow(number, StructType(list(ranged.schema.fields)).add("segment", LongType()))


def _segment_outcomes(times: np.ndarray, first_time: int, window: int) -> dict[str, np.ndarray]:
    """The open window at the end of a segment, by the one open at its start.

    One row per distinct outcome: it applies when the entering window ends before
    ``below`` (and not before the previous row's). No row applies if the entering window
    covers all requests. ``first_time`` is the client's first request: the segment that begins
    with it is entered without a window, every other one by a window that ends a window's
    length later than it, or still later. A segment without a row of its own gets one that
    never applies.
    """
    times = np.sort(times)
    # Windows open at the start were opened at its first time or before.
    candidates = np.searchsorted(times, times[0] + window, "right") + 1
    low = np.searchsorted(times, first_time + window, "right")
    _, first = np.unique(times[low:candidates], return_index=True)
    first = first + low
    if times[0] == first_time and low > 0:
        first = np.append(0, first)
    if not len(first):
        never = np.full(1, -(2**62))
        return {"below": never, "exit_end": never, "exit_count": never, "n_rows": np.full(1, len(times))}
    last = first.copy()
    while True:
        following = np.searchsorted(times, times[last] + window, "right")
        inside = following < len(times)
        if not inside.any():
            break
        last = np.where(inside, following, last)
    changes = np.r_[last[1:] != last[:-1], True]
    return {
        "below": times[first[changes]],
        "exit_end": times[last[changes]] + window,
        "exit_count": len(times) - last[changes],
        "n_rows": np.full(int(changes.sum()), len(times)),
    }


def _chain_segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entry state per client and segment from sorted segment outcomes."""
    client = segment = None
    end, count = _CLOSED
    after: tuple[int, int] | None = None
    n_rows = 0
    for batch in batches:
        changed = (batch["client"] != batch["client"].shift()) | batch["segment"].diff().ne(0)
        starts = np.flatnonzero(changed.to_numpy())
        below = batch["below"].to_numpy()
        out = []
        for low, high in zip(starts, [*starts[1:], len(batch)], strict=True):
            row = batch.iloc[low]
            if row["client"] != client or row["segment"] != segment:
                if row["client"] != client:
                    end, count = _CLOSED
                elif after is not None:
                    end, count = after
                else:
                    count += n_rows
                client, segment = row["client"], int(row["segment"])
                n_rows, after = int(row["n_rows"]), None
                out.append((client, segment, end, count))
            # The outcome that applies is the first with end < below.
            match = low + int(np.searchsorted(below[low:high], end, "right"))
            if after is None and match < high:
                chosen = batch.iloc[match]
                after = (int(chosen["exit_end"]), int(chosen["exit_count"]))
        yield pd.DataFrame(out, columns=["client", "segment", "open_end", "open_count"])


def _decide(
    ids: np.ndarray, times: np.ndarray, state: tuple[int, int], window: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the requests, and in that order their rank in their window and its end.

    ``state`` is the end of the window open before, and the requests it has had.
    """
    order = np.lexsort((ids, times))
    times = times[order]
    starts, ends, counts = [0], [state[0]], [state[1]]
    position = int(np.searchsorted(times, state[0], "right"))
    while position < len(times):
        starts.append(position)
        ends.append(int(times[position]) + window)
        counts.append(0)
        position = int(np.searchsorted(times, ends[-1], "right"))
    index = np.arange(len(times))
    which = np.searchsorted(starts, index, "right") - 1
    rank = index - np.asarray(starts)[which] + 1 + np.asarray(counts)[which]
    return order, rank, np.asarray(ends)[which]


# -- stream ----------------------------------------------------------------------------


def _numbers(values: tuple) -> np.ndarray:
    """Integers, or doubles with NaN where some are NULL."""
    if None in values:
        return np.array([np.nan if x is None else x for x in values], dtype=np.float64)
    return np.array(values, dtype=np.int64)


class _Admission(StatefulProcessor):
    """Open window per client: number of requests and end of the window."""

    _STATE = StructType([StructField("count", IntegerType()), StructField("end", LongType())])

    def __init__(self, limit: int, window: int, evict: bool):
        self.limit, self.window, self.evict = limit, window, evict

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", self._STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        requests = [(row[0], row[2]) for row in rows]
        held = self.open.get()
        count, end = (_CLOSED[1], _CLOSED[0]) if held is None else held
        ids, times = (_numbers(values) for values in zip(*requests, strict=True))
        order, rank, ends = _decide(ids, times, (end, count), self.window)
        self.open.update((int(rank[-1]), int(ends[-1])))
        if self.evict:
            self.handle.registerTimer(int(ends[-1]) // 1000 + 1)
        for place, number, window_end in zip(order.tolist(), rank.tolist(), ends.tolist(), strict=True):
            request_id, us = requests[place]
            yield Row(
                request_id=request_id, client=key[0], us=us, rank=number, window_end=window_end
            )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.open.get()
        if held is not None and held[1] // 1000 < timerValues.getCurrentWatermarkInMs():
            self.open.clear()
        return iter([])

    def close(self) -> None:
        pass


def rate_limit_stream(
    requests: DataFrame,
    limit: int = config.RATE_LIMIT_REQUESTS,
    window_seconds: int = config.RATE_LIMIT_WINDOW_SECONDS,
    evict_after: str | None = None,
) -> DataFrame:
    """``rate_limit`` over a stream, with one small state row per client.

    Within a micro-batch requests are taken by event time; a request that arrives after
    later ones were decided is judged against the window open by then. ``evict_after``
    (a watermark delay) frees the state of a client once its window has passed. Requests
    later than that are decided like others, where the client's state is gone by a fresh
    window; only for those the result may differ. Needs the RocksDB state store.
    """
    if evict_after is not None:
        at = F.col("ts").cast("timestamp")
        requests = requests.withColumn("ts", at).withWatermark("ts", evict_after)
    client_type = requests.schema["client"].dataType.simpleString()
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    # Without the watermark's column no row is late to the operator; its timers go by it still.
    decided = (
        requests.select("request_id", "client", us.alias("us"))
        .groupBy("client")
        .transformWithState(
            statefulProcessor=_Admission(
                limit, window_seconds * _MICROS, evict_after is not None
            ),
            outputStructType=(
                f"request_id bigint, client {client_type}, us bigint, rank bigint, "
                "window_end bigint"
            ),
            outputMode="Append",
            timeMode="None" if evict_after is None else "EventTime",
        )
    )
    return _decisions(decided, limit)


# -- timings ---------------------------------------------------------------------------


def request_timings(log: DataFrame) -> DataFrame:
    """Add ``total_ms`` to ``log(request_id, embedding_ms, search_ms, chat_ms)``."""
    parts = [F.coalesce(name, F.lit(0)) for name in ("embedding_ms", "search_ms", "chat_ms")]
    return log.withColumn("total_ms", parts[0] + parts[1] + parts[2])


def timing_summary(timings: DataFrame, accuracy: int = 10000) -> DataFrame:
    """One row: requests, mean and approximate median and 95th percentile total."""
    return timings.agg(
        F.count(F.lit(1)).alias("requests"),
        F.avg("total_ms").alias("avg_ms"),
        F.percentile_approx("total_ms", 0.5, accuracy).alias("median_ms"),
        F.percentile_approx("total_ms", 0.95, accuracy).alias("p95_ms"),
    )
