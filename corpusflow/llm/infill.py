"""Fill-in-middle: texts cut in three and put together with marks, middle last.

The units of a text (code points, or what a pattern matches) are the nodes of an indexable skip
list. Every lane carries two widths per link, how many units and how many code points it jumps,
so that descending from the top lane by accumulated unit widths reaches a cut rank and knows its
place in the text. Only the two places come back from Python; Spark assembles the output.

A null or empty text is plain: no cut, the empty output. So is a text that holds one of the marks.
A null key counts as an empty one. Rows stay as they are (repeated ones too), columns of the
result's names are replaced, other columns pass through, an empty table stays empty.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from corpusflow.llm.frames import append_columns, fresh, texts_of

MARKS = ("<P>", "<S>", "<M>")
PLAIN, SPM, PSM = "plain", "spm", "psm"
# A node of one lane is in the next with a chance of one in this many.
FAN = 8
# Units of a lane that needs no express lane above it.
TOP = 32


@dataclass
class Lane:
    """Links of one lane in order: their widths, and the link below that begins where each does."""

    units: np.ndarray
    points: np.ndarray
    below: np.ndarray


class SkipList:
    """An indexable skip list over units of the given widths in code points.

    Which nodes are high follows from a mix of their place, so equal texts give equal lists.
    """

    def __init__(self, widths: np.ndarray):
        self.n = len(widths)
        place = np.arange(self.n, dtype=np.int64)
        ends = np.concatenate([[0], np.cumsum(widths, dtype=np.int64)])
        self.n_points = int(ends[-1])
        self.lanes = [Lane(np.ones(self.n, np.int64), np.asarray(widths, np.int64), place)]
        while len(place) > TOP:
            mixed = place * 0x9E3779B1 + len(self.lanes) * 0x85EBCA6B & 0xFFFFFFFF
            high = (mixed ^ mixed >> 15) * 0x2C1B3C6D >> 12 & 0xFFFF
            chosen = high < 0x10000 // FAN
            chosen[0] = True  # the head stands in every lane
            if chosen.all():
                break
            below = np.flatnonzero(chosen)
            place = place[below]
            bounds = np.append(place, self.n)
            self.lanes.append(Lane(np.diff(bounds), np.diff(ends[bounds]), below))

    def points_before(self, rank: int) -> int:
        """Code points of the first ``rank`` units."""
        if not 0 <= rank <= self.n:
            raise IndexError(f"rank {rank} of {self.n} units")
        units = points = link = 0
        for level in range(len(self.lanes) - 1, -1, -1):
            lane = self.lanes[level]
            while link < len(lane.units) and units + lane.units[link] <= rank:
                units += int(lane.units[link])
                points += int(lane.points[link])
                link += 1
            if units == rank:
                break
            link = int(lane.below[link])
        return points


def unit_widths(text: str, pattern: regex.Pattern | None) -> np.ndarray:
    """Code points of each unit, left to right; together they cover the text.

    A unit begins where the one before ends and ends with its match; what follows the last
    match is a unit of its own. Empty matches are no units. Without a pattern every code point is one.
    """
    if pattern is None:
        return np.ones(len(text), np.int64)
    ends = [m.end() for m in pattern.finditer(text) if m.end() > m.start()]
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    return np.diff(np.array([0, *ends], np.int64))


def draws(key: Column | str, seed: int) -> list[Column]:
    """Four unsigned numbers of 32 bits from the SHA-256 of ``seed:key``."""
    key = F.coalesce(F.col(key).cast("string") if isinstance(key, str) else key, F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), key), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def check_marks(marks: tuple[str, str, str]) -> None:
    """Marks that could be read in two ways raise: the text would not come back."""
    for place, mark in enumerate(marks):
        others = [m for n, m in enumerate(marks) if n != place]
        ends = [mark[i:] for i in range(1, len(mark))]
        if not mark or any(mark in m for m in others):
            raise ValueError(f"{mark!r} is empty or part of another mark")
        if any(m.startswith(end) for m in marks for end in ends):
            raise ValueError(f"{mark!r} ends as a mark begins")


def fill_in_middle(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    unit: str | None = None,
    plain_percent: int = 10,
    spm_percent: int = 20,
    seed: int = 1,
    marks: tuple[str, str, str] = MARKS,
) -> DataFrame:
    """Adds ``form``, ``n_units``, ``prefix_chars``, ``middle_chars`` and ``output``.

    ``unit`` is a pattern of the regex module; None stands for code points. Both cuts are drawn
    evenly from all ranks, by the key alone. Of the texts that can be cut, ``plain_percent`` in
    a hundred stay plain; of the others ``spm_percent`` put the suffix first. Plain rows have
    null cuts and their text as output. ``marks`` open prefix, suffix and middle.
    """
    check_marks(marks)
    whole, cut_a, cut_b = fresh(docs, "whole", "cut_a", "cut_b")
    h1, h2, h3, h4 = draws(key, seed)
    holds_mark = reduce(Column.__or__, [F.contains(F.col(whole), F.lit(m)) for m in marks])
    plain = (F.col(whole) == "") | holds_mark | (h3 % 100 >= 100 - plain_percent)
    form = F.when(plain, PLAIN).when(h4 % 100 < spm_percent, SPM).otherwise(PSM)
    rows = docs.withColumn(whole, F.coalesce(F.col(text), F.lit("")))
    rows = rows.withColumns({"form": form, cut_a: h1, cut_b: h2})

    def compute():
        pattern = regex.compile(unit) if unit is not None else None

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            draw_a, draw_b, forms = (texts_of(batch, c) for c in (cut_a, cut_b, "form"))
            found = []
            for one, a, b, form in zip(texts_of(batch, whole), draw_a, draw_b, forms, strict=True):
                widths = unit_widths(one, pattern)
                n, ends = len(widths), (None, None)
                if form != PLAIN:
                    units = SkipList(widths)
                    ends = [units.points_before(r) for r in sorted((a % (n + 1), b % (n + 1)))]
                found.append((n, *ends))
            columns = zip(*found, strict=True) if found else ((), (), ())
            return [pa.array(c, pa.int64()) for c in columns]

        return work

    fields = [StructField(c, LongType()) for c in ("n_units", "prefix_chars", cut_b)]
    cut = append_columns(rows, fields, compute, drop=(cut_a,))
    start, end = F.col("prefix_chars").cast("int"), F.col(cut_b).cast("int")
    rest = F.length(whole) - end
    prefix = F.substring(whole, F.lit(1), start)
    middle = F.substring(whole, start + 1, end - start)
    suffix = F.substring(whole, end + 1, rest)
    open_prefix, open_suffix, open_middle = map(F.lit, marks)
    output = (
        F.when(F.col("form") == PLAIN, F.col(whole))
        .when(F.col("form") == SPM, F.concat(open_suffix, suffix, open_prefix, prefix, open_middle, middle))
        .otherwise(F.concat(open_prefix, prefix, open_suffix, suffix, open_middle, middle))
    )
    return cut.withColumns(
        {"output": output, "middle_chars": F.col(cut_b) - F.col("prefix_chars")}
    ).drop(whole, cut_b)


def restored(output: Column | str, form: Column | str, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that ``fill_in_middle`` has cut, from its output and form alone."""
    output = F.col(output) if isinstance(output, str) else output
    form = F.col(form) if isinstance(form, str) else form
    any_mark = "|".join(rf"\Q{m}\E" for m in marks)
    parts = F.split(output, any_mark, -1)

    def joined(*order: int) -> Column:
        return F.concat(*[F.get(parts, F.lit(i)) for i in order])

    return F.when(form == PLAIN, output).when(form == SPM, joined(2, 3, 1)).otherwise(joined(1, 3, 2))
