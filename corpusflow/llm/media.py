"""Media columns: ISO base media containers, written, inspected and read back.

``store`` puts a payload into a container as raw video: every 192 bytes are one frame of 8 by 8
pixels of three 8-bit samples, every ``group`` frames begin with one marked as a keyframe.
``inspect`` walks the nested boxes, decodes the sample tables (times, sizes, chunks, offsets,
sync samples) and gives codec, size, duration and the byte ranges of keyframes; it never looks
into the media data. ``payload`` cuts the samples out of the stored bytes by those tables.

Every row is worked on by itself, without a shuffle. A null or empty text is one frame of
spaces; a null or broken container gives null information (and a null payload). Columns of the
results' names are replaced, others pass through, repeated rows and empty tables stay as they
are.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from corpusflow.llm.frames import append_columns, texts_of

WIDTH = HEIGHT = 8
FRAME = WIDTH * HEIGHT * 3
RATE = 25
GROUP = 12
PER_CHUNK = 32

# Boxes that hold boxes, and the unit matrix of the format.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"mvex", b"udta"}
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def padded(text: str | None) -> bytes:
    """UTF-8 bytes of the text, with spaces up to a positive multiple of a frame."""
    data = (text or "").encode("utf-8")
    return data.ljust(max(1, -(-len(data) // FRAME)) * FRAME, b" ")


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def container(payload: bytes, group: int = GROUP) -> bytes:
    """The payload as one raw video track; header first, so that it can be streamed."""
    frames = len(payload) // FRAME
    chunks, rest = divmod(frames, PER_CHUNK)
    runs = [(1, PER_CHUNK, 1)] if chunks else []
    if rest:
        runs.append((chunks + 1, rest, 1))
        chunks += 1
    keys = np.arange(1, frames + 1, group, dtype=">u4")
    entry = box(
        b"raw ",
        struct.pack(">6xH16x2H2II H32sHh", 1, WIDTH, HEIGHT, 0x480000, 0x480000, 0, 1, b"", 24, -1),
    )
    kind = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"iso2", b"mp41")

    def header(first: int) -> bytes:
        offsets = first + np.arange(chunks, dtype=np.uint64) * (PER_CHUNK * FRAME)
        wide = first + len(payload) >= 1 << 32
        table = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">3I", 1, frames, 1)),
            full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">3I", *r) for r in runs)),
            full(b"stsz", struct.pack(">2I", FRAME, frames)),
            full(
                b"co64" if wide else b"stco",
                struct.pack(">I", chunks),
                offsets.astype(">u8" if wide else ">u4").tobytes(),
            ),
        )
        source = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
        media = box(
            b"mdia",
            full(b"mdhd", struct.pack(">4I2H", 0, 0, RATE, frames, 0x55C4, 0)),
            full(b"hdlr", struct.pack(">I4s12x", 0, b"vide"), b"video\0"),
            box(b"minf", full(b"vmhd", bytes(8), flags=1), source, table),
        )
        track = full(
            b"tkhd",
            struct.pack(">5I8x4H", 0, 0, 1, 0, frames, 0, 0, 0, 0),
            MATRIX,
            struct.pack(">2I", WIDTH << 16, HEIGHT << 16),
            flags=3,
        )
        movie = struct.pack(">4IIH10x", 0, 0, RATE, frames, 0x10000, 0x100)
        return box(
            b"moov",
            full(b"mvhd", movie, MATRIX, bytes(24), struct.pack(">I", 2)),
            box(b"trak", track, media),
        )

    start = len(kind) + len(header(0)) + 8
    big = 8 + len(payload) >= 1 << 32
    if big:  # the size field of a box has 32 bits, or 64 more after the kind
        start = len(kind) + len(header(1 << 32)) + 16
    head = (
        struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload))
        if big
        else struct.pack(">I4s", 8 + len(payload), b"mdat")
    )
    return kind + header(start) + head + payload


# Boxes within boxes; real files have less than ten.
MAX_DEPTH = 32


def boxes(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """Kind, start and end of the body of every box from ``start`` on, one level deep."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError(f"box {kind!r} at {start} does not fit")
        yield kind, body, start + size
        start += size


def walk(data: bytes, start: int = 0, end: int | None = None, path: tuple = ()) -> Iterator[tuple]:
    """Path of kinds, start and end of the body of every box, parents first."""
    if len(path) > MAX_DEPTH:
        raise ValueError("boxes nested too deep")
    for kind, a, b in boxes(data, start, end):
        yield (*path, kind), a, b
        if kind in CONTAINERS:
            yield from walk(data, a, b, (*path, kind))


def tracks(data: bytes) -> list[dict[bytes, tuple[int, int]]]:
    """Per track the boxes below it by kind."""
    found: list[dict[bytes, tuple[int, int]]] = []
    for path, a, b in walk(data):
        if path[-1] == b"trak":
            found.append({})
        elif b"trak" in path and found:
            found[-1].setdefault(path[-1], (a, b))
    return found


def numbers(data: bytes, place: tuple[int, int], columns: int, kind: str = ">u4") -> np.ndarray:
    """The table of a full box that begins with its row count."""
    start, end = place
    (rows,) = struct.unpack_from(">I", data, start + 4)
    width = np.dtype(kind).itemsize * columns
    if start + 8 + rows * width > end:
        raise ValueError("table longer than its box")
    flat = np.frombuffer(data, kind, rows * columns, start + 8)
    return flat.astype(np.int64).reshape(rows, columns)


def inside_media(data: bytes, offsets: np.ndarray, sizes: np.ndarray) -> bool:
    """Whether every sample lies within the body of one ``mdat`` box."""
    bodies = [(a, b) for kind, a, b in boxes(data) if kind == b"mdat"]
    held = np.zeros(len(offsets), bool)
    for a, b in bodies:
        held |= (offsets >= a) & (offsets + sizes <= b)
    return bool(held.all())


def sample_table(data: bytes, track: dict[bytes, tuple[int, int]]) -> dict:
    """Offsets, sizes, times and keyframes of a track's samples, from its tables only.

    Tables that disagree with each other or with the stored bytes raise, before anything is
    allocated by a count that the bytes don't bear out.
    """
    start = track[b"stsz"][0]
    size, count = struct.unpack_from(">2I", data, start + 4)
    if size:
        if size * count > len(data):
            raise ValueError("samples beyond the end")
        sizes = np.full(count, size, np.int64)
    else:
        if start + 12 + 4 * count > track[b"stsz"][1]:
            raise ValueError("table longer than its box")
        sizes = np.frombuffer(data, ">u4", count, start + 12).astype(np.int64)
    wide = b"co64" in track
    chunks = numbers(data, track[b"co64" if wide else b"stco"], 1, ">u8" if wide else ">u4")[:, 0]
    runs = numbers(data, track[b"stsc"], 3)
    lengths = np.diff(np.append(runs[:, 0] - 1, len(chunks)))
    per_chunk = np.repeat(runs[:, 1], lengths)
    if per_chunk.sum() != count or len(per_chunk) != len(chunks):
        raise ValueError("chunks and sizes disagree")
    firsts = np.cumsum(per_chunk) - per_chunk
    before = np.cumsum(sizes) - sizes
    offsets = np.repeat(chunks - before[firsts], per_chunk) + before
    if not inside_media(data, offsets, sizes):
        raise ValueError("samples outside the stored media")
    times = numbers(data, track[b"stts"], 2)
    if times[:, 0].sum() != count:
        raise ValueError("times and sizes disagree")
    if b"stss" in track:
        keys = numbers(data, track[b"stss"], 1)[:, 0] - 1
        if len(keys) and (keys[0] < 0 or keys[-1] >= count or (np.diff(keys) <= 0).any()):
            raise ValueError("keyframes that are no samples")
    else:
        keys = np.arange(count)  # without the table every sample is one
    return {
        "offsets": offsets,
        "sizes": sizes,
        "ticks": int((times[:, 0] * times[:, 1]).sum()),
        "keys": keys,
    }


def information(data: bytes) -> dict:
    """Codec, picture size, duration and keyframe ranges of the first track."""
    track = tracks(data)[0]
    start = track[b"stsd"][0] + 8
    codec = data[start + 4 : start + 8].decode("latin-1").strip()
    width, height = struct.unpack_from(">2H", data, start + 8 + 24)
    long_form = data[track[b"mdhd"][0]] == 1
    (scale,) = struct.unpack_from(">I", data, track[b"mdhd"][0] + (20 if long_form else 12))
    table = sample_table(data, track)
    return {
        "codec": codec,
        "width": width,
        "height": height,
        "n_samples": len(table["sizes"]),
        "duration_s": table["ticks"] / scale,
        "keyframes": [
            {"offset": o, "size": s}
            for o, s in zip(
                table["offsets"][table["keys"]].tolist(),
                table["sizes"][table["keys"]].tolist(),
                strict=True,
            )
        ],
    }


def samples(data: bytes) -> bytes:
    """All samples of the first track in order; runs that lie side by side are cut out at once."""
    table = sample_table(data, tracks(data)[0])
    offsets, sizes = table["offsets"], table["sizes"]
    if not len(offsets):
        return b""
    breaks = np.flatnonzero(offsets[1:] != offsets[:-1] + sizes[:-1]) + 1
    starts = offsets[np.append(0, breaks)].tolist()
    lasts = np.append(breaks, len(offsets)) - 1
    ends = (offsets[lasts] + sizes[lasts]).tolist()
    return b"".join(data[a:b] for a, b in zip(starts, ends, strict=True))


def _safe(function, data: bytes | None):
    """The function's result, or None where the container is missing or broken."""
    try:
        return None if data is None else function(data)
    except (ValueError, KeyError, IndexError, struct.error, ZeroDivisionError, OverflowError):
        return None


RANGE = StructType([StructField("offset", LongType()), StructField("size", LongType())])
INFORMATION = StructType(
    [
        StructField("codec", StringType()),
        StructField("width", IntegerType()),
        StructField("height", IntegerType()),
        StructField("n_samples", LongType()),
        StructField("duration_s", DoubleType()),
        StructField("keyframes", ArrayType(RANGE)),
    ]
)
ARROW_INFORMATION = pa.struct(
    [
        ("codec", pa.string()),
        ("width", pa.int32()),
        ("height", pa.int32()),
        ("n_samples", pa.int64()),
        ("duration_s", pa.float64()),
        ("keyframes", pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())]))),
    ]
)


def store(
    docs: DataFrame, text: str = "text", media: str = "media", group: int = GROUP
) -> DataFrame:
    """``text`` as a container in the new column ``media``."""

    def compute():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            rows = [container(padded(t), group) for t in texts_of(batch, text)]
            return [pa.array(rows, pa.binary())]

        return work

    return append_columns(docs, [StructField(media, BinaryType())], compute, rows=256)


def inspect(docs: DataFrame, media: str = "media", info: str = "info") -> DataFrame:
    """Adds ``info``: codec, picture size, samples, duration and keyframe byte ranges."""

    def compute():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            rows = [_safe(information, data) for data in texts_of(batch, media)]
            return [pa.array(rows, ARROW_INFORMATION)]

        return work

    return append_columns(docs, [StructField(info, INFORMATION)], compute, rows=256)


def payload(docs: DataFrame, media: str = "media", data: str = "payload") -> DataFrame:
    """Adds ``payload``: the stored samples, read back by the sample tables."""

    def compute():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            return [pa.array([_safe(samples, d) for d in texts_of(batch, media)], pa.binary())]

        return work

    return append_columns(docs, [StructField(data, BinaryType())], compute, rows=256)


def inspect_and_read(
    docs: DataFrame, media: str = "media", info: str = "info", data: str = "payload"
) -> DataFrame:
    """``inspect`` and ``payload`` in one pass over the containers."""

    def compute():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            found = texts_of(batch, media)
            return [
                pa.array([_safe(information, d) for d in found], ARROW_INFORMATION),
                pa.array([_safe(samples, d) for d in found], pa.binary()),
            ]

        return work

    fields = [StructField(info, INFORMATION), StructField(data, BinaryType())]
    return append_columns(docs, fields, compute, rows=256)
