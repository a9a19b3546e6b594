import hashlib
import struct
import zlib

import pytest

from corpusflow.llm import media, queries


@pytest.mark.parametrize("size", [0, 1, 191, 192, 193, 192 * 32, 192 * 33, 192 * 70 + 5])
def test_round_trip(size):
    text = "é" * (size // 2) + "x" * (size % 2)
    data = media.container(media.padded(text))
    payload = media.samples(data)
    assert payload == text.encode().ljust(max(1, -(-size // 192)) * 192, b" ")
    info = media.information(data)
    assert (info["codec"], info["width"], info["n_samples"]) == ("raw", 8, len(payload) // 192)
    assert info["duration_s"] == info["n_samples"] / media.RATE
    for n, key in enumerate(info["keyframes"]):
        start = n * media.GROUP * 192
        assert data[key["offset"] :][: key["size"]] == payload[start : start + 192]


def test_tables_written_otherwise():
    """Sizes of each sample, wide offsets, chunks out of order, no sync table, 64-bit boxes."""
    parts = [b"aaa", b"bb", b"cccc"]
    entry = media.box(b"raw ", struct.pack(">6xH16x2H50x", 1, 4, 2))

    def build(offsets):
        table = media.box(
            b"stbl",
            media.full(b"stsd", struct.pack(">I", 1), entry),
            media.full(b"stts", struct.pack(">5I", 2, 2, 10, 1, 30)),
            media.full(b"stsc", struct.pack(">4I", 1, 1, 1, 1)),
            media.full(b"stsz", struct.pack(">5I", 0, 3, *map(len, parts))),
            media.full(b"co64", struct.pack(">I3Q", 3, *offsets)),
        )
        head = media.full(b"mdhd", struct.pack(">4I2H", 0, 0, 100, 50, 0, 0))
        return media.box(b"moov", media.box(b"trak", media.box(b"mdia", head, media.box(b"minf", table))))

    body = parts[2] + b"-" + parts[0] + parts[1]
    data = struct.pack(">I4sQ", 1, b"mdat", 16 + len(body)) + body
    data += build([16 + 5, 16 + 8, 16])
    assert media.samples(data) == b"aaabbcccc"
    info = media.information(data)
    assert info["duration_s"] == 0.5 and len(info["keyframes"]) == 3


def track(count, size=192, offsets=(None,), runs=((1, 1, 1),), times=None, keys=(1,), body=b"x" * 192):
    """A container with one track whose tables say what they are told to."""
    entry = media.box(b"raw ", struct.pack(">6xH16x2H50x", 1, 4, 2))
    times = ((count, 1),) if times is None else times
    lead = media.box(b"free", b"12345678")
    place = len(lead) + 8

    def rows(numbers):
        return struct.pack(f">{len(numbers)}I", *numbers)

    tables = media.box(
        b"stbl",
        media.full(b"stsd", struct.pack(">I", 1), entry),
        media.full(b"stts", rows([len(times), *(n for row in times for n in row)])),
        media.full(b"stss", rows([len(keys), *keys])),
        media.full(b"stsc", rows([len(runs), *(n for row in runs for n in row)])),
        media.full(b"stsz", rows([size, count])),
        media.full(b"stco", rows([len(offsets), *(place if o is None else o for o in offsets)])),
    )
    head = media.full(b"mdhd", struct.pack(">4I2H", 0, 0, 100, 50, 0, 0))
    moov = media.box(b"moov", media.box(b"trak", media.box(b"mdia", head, media.box(b"minf", tables))))
    return lead + media.box(b"mdat", body) + moov


BROKEN = {
    "offset in a header": track(1, offsets=(0,)),
    "offset after the media": track(1, offsets=(230,)),
    "sample over the end of the media": track(1, 193),
    "sync sample 0": track(1, keys=(0,)),
    "sync sample beyond": track(1, keys=(2,)),
    "sync samples out of order": track(2, 96, runs=((1, 2, 1),), keys=(2, 1)),
    "more times than samples": track(1, times=((99, 4),)),
    "fewer times than samples": track(2, 96, runs=((1, 2, 1),), times=((1, 4),)),
    "billions of samples": track(2**32 - 1),
    "billions of empty samples": track(2**32 - 1, 0),
    "billions in a run": track(1, runs=((1, 2**32 - 1, 1),)),
    "runs out of order": track(1, runs=((2, 1, 1), (1, 1, 1))),
    "no track": media.box(b"moov", b""),
}


@pytest.mark.parametrize("name", BROKEN)
def test_tables_that_disagree_are_refused(name):
    assert media._safe(media.information, BROKEN[name]) is None
    assert media._safe(media.samples, BROKEN[name]) is None


def test_tables_that_agree_are_read():
    assert media.samples(track(1)) == b"x" * 192
    assert media.information(track(2, 96, runs=((1, 2, 1),), keys=(1, 2)))["n_samples"] == 2


def test_deep_nesting_is_refused():
    data = b""
    for _ in range(3000):
        data = media.box(b"moov", data)
    assert media._safe(media.information, data) is None


def test_one_pass_gives_what_two_give(spark):
    rows = [(1, media.container(media.padded("hello"))), (2, None), (3, BROKEN["sync sample 0"])]
    df = spark.createDataFrame(rows, "doc_id long, media binary")
    both = media.inspect_and_read(df).orderBy("doc_id").collect()
    assert both == media.payload(media.inspect(df)).orderBy("doc_id").collect()


def test_broken_containers_give_null(spark):
    good = media.container(media.padded("hello"))
    rows = [(1, good), (2, None), (3, b""), (4, good[:300]), (5, good[:-1]), (6, b"\0" * 40)]
    df = spark.createDataFrame(rows, "doc_id long, media binary")
    out = {r["doc_id"]: r for r in media.payload(media.inspect(df)).collect()}
    assert out[1]["info"]["n_samples"] == 1
    assert all(out[k]["info"] is None and out[k]["payload"] is None for k in range(2, 7))


def test_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in queries.documents(spark, sf_dir).collect()}
    for row in queries.op1_media(spark, sf_dir).collect():
        data = texts[row["doc_id"]].encode()
        payload = media.padded(texts[row["doc_id"]])
        assert (row["n_bytes"], row["payload_bytes"]) == (len(data), len(payload))
        assert row["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert row["tail_crc32"] == zlib.crc32(payload[-16:])
        stored = media.container(payload)
        assert row["media_sha256"] == hashlib.sha256(stored).hexdigest()
        assert row["media_bytes"] == len(stored)
