import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from corpusflow.streaming import admission

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def requests(spark, rows):
    """rows of (request_id, client, microseconds)"""
    df = spark.createDataFrame(rows, "request_id bigint, client string, us bigint")
    return df.select("request_id", "client", F.timestamp_micros("us").alias("ts"))


def model(rows, limit, window):
    state, out = {}, {}
    for request, client, us in sorted(rows, key=lambda r: (r[2], r[0])):
        count, end = state.get(client, (0, None))
        if end is None or us > end:
            count, end = 0, us + window
        count += 1
        state[client] = (count, end)
        wait = None if count <= limit else -(-(end - us) // 1_000_000)
        out[request] = (count <= limit, max(limit - count, 0), end, wait)
    return out


def decisions(df):
    rows = df.withColumn("end", F.unix_micros("reset_at")).collect()
    return {r.request_id: (r.allowed, r.remaining, r.end, r.retry_after) for r in rows}


def test_window_edges(spark):
    second = 1_000_000
    rows = [(i, "a", i * 1000) for i in range(21)]
    rows += [(21, "a", 60 * second), (22, "a", 60 * second + 1), (23, "a", 60 * second + 1)]
    rows += [(30, "b", 5)]
    got = decisions(admission.rate_limit(requests(spark, rows)))
    assert got == model(rows, 20, 60 * second)
    assert got[19][0] and got[19][1] == 0
    assert not got[20][0] and got[20][3] == 60
    assert not got[21][0] and got[21][3] == 0     # exactly at the end: old window
    assert got[22][0] and got[22][1] == 19        # one microsecond later: new window
    assert got[30] == (True, 19, 5 + 60 * second, None)


@pytest.mark.parametrize("segments", [1, 100, 10**6])
@pytest.mark.parametrize("busy_rows", [0, 300, 10**6])
def test_splitting_does_not_change_decisions(spark, segments, busy_rows):
    rng = random.Random(segments)
    rows, base = [], -3_000_000_000
    for i in range(3000):
        # One client has most requests; times repeat and have gaps.
        client = rng.choice(["hot", "hot", "hot", "b", "c", "d"])
        spread = rng.choice([1, 1000, 40_000_000, 2_000_000_000])
        rows.append((i, client, base + rng.randrange(0, spread + 1) + rng.choice([0, 0, 5 * 10**9])))
    df = requests(spark, rows).repartition(5)
    got = decisions(admission.rate_limit(df, 7, 10, busy_rows, segments))
    assert got == model(rows, 7, 10_000_000)


def test_regular_arrivals_across_segments(spark):
    # Evenly spaced: windows never realign, so every entry state has its own outcome.
    rows = [(i, "a", i * 700_000) for i in range(2000)]
    got = decisions(admission.rate_limit(requests(spark, rows), 3, 10, 0, 90))
    assert got == model(rows, 3, 10_000_000)


def test_a_burst_within_one_window_is_cut(spark):
    rng = random.Random(8)
    rows = [(i, "a", 1000 + rng.randrange(5_000_000)) for i in range(3000)]  # all in one window
    df = requests(spark, rows)
    assert decisions(admission.rate_limit(df, 20, 10, 100, 70)) == model(rows, 20, 10_000_000)
    timed = df.select("request_id", "client", F.unix_micros("ts").alias("us"))
    cut = admission._in_segments(timed, 70)
    assert cut.groupBy("client", "segment").count().agg(F.max("count")).first()[0] <= 70
    by_time = cut.orderBy("us", "request_id").collect()
    assert [r.segment for r in by_time] == sorted(r.segment for r in by_time)


@pytest.mark.parametrize("before", [0, 3, 40])
def test_bursts_after_a_trickle_and_at_one_instant(spark, before):
    second = 1_000_000
    rows = [(i, "a", i * second) for i in range(before)]
    for burst, at in enumerate((9 * second, 9 * second, 12 * second, 50 * second + 1)):
        rows += [(1000 * (burst + 1) + i, "a", at + (i // 100 if burst else 0)) for i in range(400)]
    rows += [(9000 + i, None, i * second) for i in range(150)]
    df = requests(spark, rows)
    for segment in (1, 37, 400):
        got = decisions(admission.rate_limit(df, 7, 10, 60, segment))
        assert got == model(rows, 7, 10 * second)


def test_outcomes_are_few_within_the_first_window():
    import numpy as np

    times = np.arange(1000, 51_000)
    inside = admission._segment_outcomes(times, 0, 10**6)
    assert len(inside["below"]) == 1 and inside["below"][0] < 0 and inside["n_rows"][0] == 50_000
    assert len(admission._segment_outcomes(times, 1000, 10**6)["below"]) == 1


@pytest.mark.parametrize("evict_after", [None, "1 hour"])
def test_stream_equals_batch(spark, tmp_path, evict_after):
    rng = random.Random(4)
    times = sorted(rng.randrange(0, 600_000_000) for _ in range(900))
    rows = [(i, rng.choice("aaabc"), us) for i, us in enumerate(times)]
    for part in range(3):
        batch = requests(spark, rows[part * 300:(part + 1) * 300])
        batch.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = (
        spark.readStream.schema("request_id bigint, client string, ts timestamp")
        .option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    )
    name = "admitted_" + ("kept" if evict_after is None else "evicted")
    query = (
        admission.rate_limit_stream(stream, 5, 20, evict_after)
        .writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", str(tmp_path / "cp")).start()
    )
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert decisions(spark.table(name)) == model(rows, 5, 20_000_000)


def test_late_requests_are_decided_after_eviction(spark, tmp_path):
    second = 1_000_000
    rows = [(i, "a", i * second) for i in range(8)]
    later = [(10 + i, "b", (1000 + 200 * i) * second) for i in range(2)]
    # Client a's state is gone, c was never seen; all of their requests are late.
    late = [(20 + i, "aaaaaaaccccccc"[i], (30 + i) * second) for i in range(14)]
    after = [(40, "a", 2000 * second)]
    for part in (rows, later[:1], later[1:], late, after):
        requests(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = (
        spark.readStream.schema("request_id bigint, client string, ts timestamp")
        .option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    )
    query = (
        admission.rate_limit_stream(stream, 5, 20, "60 seconds")
        .writeStream.format("memory").queryName("admitted_late").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "cp")).start()
    )
    try:
        query.processAllAvailable()
        kept = query.lastProgress.stateOperators[0].numRowsTotal
    finally:
        query.stop()
    assert kept == 1  # client a's last window; all others are evicted
    assert decisions(spark.table("admitted_late")) == model(
        [*rows, *later, *late, *after], 5, 20 * second
    )


def test_registered_stream_decides_a_late_file(spark):
    from corpusflow.plans import catalog

    sf_dir = "/root/testdata/sf0.001"
    got = {r.request_id: r for r in catalog.rate_limit_stream(spark, sf_dir).collect()}
    wanted = catalog.rate_limit(spark, sf_dir).collect()
    assert len(got) == len(wanted)
    assert all(got[r.request_id].allowed == r.allowed for r in wanted)


def test_registered_stream_writes_its_parts_in_several_tasks(spark, tmp_path, monkeypatch):
    from corpusflow.plans import catalog

    ts = F.timestamp_micros(F.lit(10**15) + F.col("id") * 10**9)
    rows = spark.range(600, numPartitions=4).select(
        F.col("id").alias("event_id"), (F.col("id") % 30).alias("user_id"), ts.alias("ts")
    )
    rows.repartition(4, "event_id").write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(catalog, "_new_folder", lambda spark: str(tmp_path))
    got = {r.request_id: r.allowed for r in catalog.rate_limit_stream(spark, str(tmp_path)).collect()}
    assert got == {r.request_id: r.allowed for r in catalog.rate_limit(spark, str(tmp_path)).collect()}
    assert len(list((tmp_path / "events").glob("part-*"))) > 5
    assert len(list((tmp_path / "state/commits").glob("[0-9]*"))) == 5


def test_client_key(spark):
    rows = [
        (" 1.1.1.1 , 2.2.2.2", "r", "c", "1.1.1.1"), (",2.2.2.2", "r", "c", ""),
        ("", "r", "c", "r"), (None, "", "c", "c"), (None, None, None, "unknown"),
    ]
    df = spark.createDataFrame(rows, "xff string, real_ip string, cdn_ip string, expected string")
    for r in admission.with_client_key(df).collect():
        assert r.client == r.expected


def test_timings(spark):
    df = spark.createDataFrame(
        [(1, 10, 20, None), (2, 1, 2, 3)],
        "request_id bigint, embedding_ms bigint, search_ms bigint, chat_ms bigint",
    )
    total = admission.request_timings(df)
    assert {r.request_id: r.total_ms for r in total.collect()} == {1: 30, 2: 6}
    assert tuple(admission.timing_summary(total).first()) == (2, 18.0, 6, 30)
