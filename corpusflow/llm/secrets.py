"""Secret scan: keyword prefilter, anchored patterns near its hits, checksum validation.

An Aho-Corasick automaton finds the keywords of all detectors in one pass over a text. A
detector's pattern is tried only where one of its keywords begins, so a text without keywords
costs one pass. Runs of hexadecimal digits have no keyword: their prefilter is a search for
the shortest run in the text mapped to two symbols. Detectors whose secrets carry a checksum
report only those that it confirms.

Per detector, matches are leftmost and do not overlap; one that is too short or fails its
checksum still uses up its characters. Positions are code points, the end exclusive. A null or
empty text has no secrets. Columns of the result's name are replaced, others pass through,
rows stay as they are (repeated ones too), an empty table stays empty.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from corpusflow.llm.frames import append_columns, texts_of

HEX_RUN = 24

# Digits of the checksum at the end of access tokens.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Detector:
    kind: str
    keywords: tuple[str, ...]  # in lower case; a match begins with one of them
    pattern: re.Pattern
    valid: Callable[[re.Match], bool]


def checksum_holds(match: re.Match) -> bool:
    """The last six characters are the CRC-32 of the 30 before, in base 62."""
    body, digits = match[1][:30], match[1][30:]
    value = 0
    for digit in digits:
        value = value * 62 + BASE62.index(digit)
    return value == zlib.crc32(body.encode("ascii"))


DETECTORS = (
    Detector(
        "assign",
        ("password", "passwd", "secret", "token", "api_key", "apikey"),
        re.compile(
            r"((?i:password|passwd|secret|token|api_?key))"
            r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
            re.ASCII,
        ),
        lambda match: len(match[2]) >= 6,
    ),
    Detector(
        "access", ("akia",), re.compile(r"AKIA[A-Z0-9]+"), lambda match: len(match[0]) >= 20
    ),
    Detector("hex", (), re.compile(r"[0-9a-f]+"), lambda match: len(match[0]) >= HEX_RUN),
    Detector(
        "github",
        ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
        re.compile(r"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])"),
        checksum_holds,
    ),
    Detector(
        "npm",
        ("npm_",),
        re.compile(r"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])"),
        checksum_holds,
    ),
)
KINDS = [d.kind for d in DETECTORS]
BASE_KINDS = ("assign", "access", "hex")

SPAN = StructType(
    [
        StructField("kind", StringType()),
        StructField("start", LongType()),
        StructField("end", LongType()),
    ]
)
ARROW_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

_HEX_MAP = bytes(ord("h") if chr(b) in "0123456789abcdef" else ord(".") for b in range(256))


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """Keyword to its length and the number of its detector."""
    keywords = ahocorasick.Automaton()
    for number, detector in enumerate(DETECTORS):
        for keyword in detector.keywords:
            keywords.add_word(keyword, (len(keyword), number))
    keywords.make_automaton()
    return keywords


def spans(text: str) -> list[tuple[str, int, int]]:
    """Secrets of one text by start, then by detector."""
    # One byte per code point, so that places agree; only ASCII matters and is lower-cased.
    coarse = text.encode("latin-1", "replace")
    starts: dict[int, list[int]] = {}
    for end, (length, number) in automaton().iter(coarse.lower().decode("latin-1")):
        starts.setdefault(number, []).append(end + 1 - length)
    runs = coarse.translate(_HEX_MAP)
    place = runs.find(b"h" * HEX_RUN)
    while place >= 0:
        starts.setdefault(KINDS.index("hex"), []).append(place)
        after = runs.find(b".", place)
        place = runs.find(b"h" * HEX_RUN, after) if after >= 0 else -1
    found = []
    for number, places in starts.items():
        detector, free = DETECTORS[number], 0
        for start in sorted(places):
            if start >= free and (match := detector.pattern.match(text, start)):
                free = match.end()
                if detector.valid(match):
                    found.append((start, number, free))
    return [(KINDS[number], start, end) for start, number, end in sorted(found)]


def scan_secrets(docs: DataFrame, text: str = "text", secrets: str = "secrets") -> DataFrame:
    """Adds ``secrets``: an array of kind, start and end of every secret in ``text``."""

    def compute():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            rows = [
                [dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans(t)] if t else []
                for t in texts_of(batch, text)
            ]
            return [pa.array(rows, pa.list_(ARROW_SPAN))]

        return work

    return append_columns(docs, [StructField(secrets, ArrayType(SPAN))], compute)
