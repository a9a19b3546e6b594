"""Large JSON files as rows: an array, an object or lines, read in blocks and checked to the end.

A file may be one array, one object (where asked for) or one value per line. Spark reads it in
splits, cut at commas, and consecutive pieces are packed into blocks of ``BLOCK_CHARS``. Whether a
block begins within a string, and how deep, follows from the blocks before it: each is summed
up for both cases (quotes, brackets), and a running sum over the blocks of a file settles which
holds. With that every block is cut into elements by itself; only what lies across a border of
blocks is put together by a shuffle. No file is a single string or row anywhere.

Everything that is not exactly of the expected form raises: text before or after, a second
array, a missing or extra comma, an unclosed string or bracket, two values on a line.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from corpusflow.functions.lineage import stored

BLOCK_CHARS = 4 << 20

_STRING = r'"[^"\\]*(?:\\.[^"\\]*)*(?:"|\\?\Z)'
_TOKEN = re.compile(_STRING + r"|[\[\]{},\n]", re.DOTALL)
_STRINGS = re.compile(_STRING, re.DOTALL)
_REST_OF_STRING = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*(?:"|\\?\Z)', re.DOTALL)
_ESCAPES = re.compile(r"\\.", re.DOTALL)
_BLOCKS = "file string, start long, part int, size long, n_bytes long, text string"


class MalformedFile(ValueError):
    """A JSON file that is not what it should be."""


def read_blocks(spark: SparkSession, path: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Blocks of the files at ``path``: ``(file, start, part, size, n_bytes, text)``.

    Every piece is followed by its comma. The last one of a file has one too many unless
    the file itself ends with it, which ``n_bytes`` and the file's ``size`` tell.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        length, part, key = 0, 0, None

        def block() -> pa.RecordBatch:
            text = ",".join(held) + ","
            row = [*key[:2], part, key[2], len(text.encode("utf-8")), text]
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            names = ["file", "start", "part", "size", "n_bytes", "text"]
            return pa.RecordBatch.from_arrays(
                [pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], names
            )

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for value, *of in zip(*columns, strict=True):
                if tuple(of) != key or length >= block_chars:
                    if held:
                        yield block()
                    held, length = [], 0
                    part = part + 1 if tuple(of) == key else 0
                    key = tuple(of)
                held.append(value)
                length += len(value) + 1
        if held:
            yield block()

    return (
        spark.read.text(path, lineSep=",")
        .select(
            "value",
            F.col("_metadata.file_path"),
            F.col("_metadata.file_block_start"),
            F.col("_metadata.file_size"),
        )
        .mapInArrow(pack, _BLOCKS)
    )


def blocks_of(files: DataFrame) -> DataFrame:
    """``files(file_ord, value)`` held as strings, as one block each."""
    size = F.octet_length("value").cast("long")
    return files.where("value is not null").select(
        F.lpad(F.col("file_ord").cast("string"), 19, "0").alias("file"),
        F.lit(0).cast("long").alias("start"),
        F.lit(0).alias("part"),
        size.alias("size"),
        size.alias("n_bytes"),
        F.col("value").alias("text"),
        F.lit(True).alias("whole"),
    )


def _summed_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block: parity of its quotes, and change of depth if it begins outside or within a string."""

    def change(text: str) -> int:
        bare = _STRINGS.sub("", text)
        return sum(map(bare.count, "[{")) - sum(map(bare.count, "]}"))

    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        quotes, outside, within, first = [], [], [], []
        for text in texts:
            quotes.append(_ESCAPES.sub("", text).count('"') % 2)
            outside.append(change(text))
            within.append(change(text[_REST_OF_STRING.match(text).end() :]))
            first.append(text.lstrip()[:1] or None)
        new = [pa.array(c, pa.int64()) for c in (quotes, outside, within)]
        keys = [batch.column(i) for i in range(5)]
        yield pa.RecordBatch.from_arrays(
            [*keys, *new, pa.array(first, pa.string())],
            ["file", "start", "part", "size", "n_bytes", "quotes", "outside", "within", "first"],
        )


def elements(blocks: DataFrame, container: str = "[") -> DataFrame:
    """``(file_ord, pos, element)``: the text of every element, numbered by file and position.

    ``container`` opens the one array or object that a file may be; for "[" the alternative
    is one value per line, where blank lines are none. Files are numbered by name.
    """
    whole = "whole" in blocks.columns
    keys = ["file", "start", "part"]
    blocks = stored(blocks)
    sums = blocks.select(*keys, "size", "n_bytes", "text").mapInArrow(
        _summed_up,
        "file string, start long, part int, size long, n_bytes long, quotes long, outside long, "
        "within long, first string",
    )
    in_file = Window.partitionBy("file")
    order = in_file.orderBy("start", "part")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everywhere = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def so_far(value: Column) -> Column:
        return F.coalesce(F.sum(value).over(before), F.lit(0))

    # Narrow rows, one per block.
    state = (
        stored(sums)
        .withColumns(
            {
                "in_string": so_far(F.col("quotes")) % 2 == 1,
                "number": F.row_number().over(order),
                "last": F.lead("file").over(order).isNull(),
                "total": F.sum("n_bytes").over(in_file),
                "opens": F.first("first", ignorenulls=True).over(everywhere),
            }
        )
        .withColumn("change", F.when(F.col("in_string"), F.col("within")).otherwise(F.col("outside")))
        .withColumn("depth", so_far(F.col("change")))
    )
    ended = (F.col("depth") + F.col("change") == 0) & (
        (F.col("in_string").cast("int") + F.col("quotes")) % 2 == 0
    )
    unclosed = F.concat(F.lit("malformed file: not closed at its end: "), "file")
    depth = F.when(F.col("last") & ~ended, F.raise_error(unclosed).cast("long")).otherwise(F.col("depth"))
    # The comma after the last piece is the file's own only if the bytes add up with it.
    added = F.lit(False) if whole else F.col("last") & (F.col("total") != F.col("size"))
    state = state.select(*keys, "in_string", depth.alias("depth"), "number", "opens", added.alias("trim"))
    cut = stored(
        blocks.select(*keys, "text")
        .join(state, keys)
        .mapInArrow(
            _cut(container),
            "file string, number int, boxed boolean, local long, n_local long, element string",
        )
    )
    # One row per block: in how many places it is cut.
    cuts = cut.where("local = 0").select("file", "number", (F.col("n_local") - 1).alias("n"))
    in_order = Window.partitionBy("file").orderBy("number")
    places = cuts.select(
        "file",
        "number",
        F.coalesce(F.sum("n").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("place"),
        F.sum("n").over(Window.partitionBy("file")).alias("file_cuts"),
        F.max("number").over(Window.partitionBy("file")).alias("last_number"),
    )
    if whole:
        numbers = places.select("file", F.col("file").cast("long").alias("file_ord")).distinct()
    else:
        by_name = Window.orderBy("file")
        numbers = places.select("file").distinct().select(
            "file", (F.row_number().over(by_name) - 1).cast("long").alias("file_ord")
        )
    placed = cut.join(places.join(numbers, "file"), ["file", "number"]).select(
        "file_ord",
        (F.col("place") + F.col("local")).alias("pos"),
        "number",
        "element",
        (~F.col("boxed") | (F.col("file_cuts") == 0)).alias("may_be_blank"),
        ((F.col("local") > 0) | (F.col("number") == 1)).alias("begun_here"),
        ((F.col("local") < F.col("n_local") - 1) | (F.col("number") == F.col("last_number"))).alias("ended_here"),
    )
    columns = ["file_ord", "pos", "may_be_blank", "element"]
    inner = F.col("begun_here") & F.col("ended_here")
    # What lies across a border of blocks: at most two rows a block; an element's pieces meet.
    pieces = F.sort_array(F.collect_list(F.struct("number", "element")))
    across = (
        placed.where(~inner)
        .groupBy("file_ord", "pos", "may_be_blank")
        .agg(F.array_join(F.transform(pieces, lambda p: p["element"]), "").alias("element"))
    )
    found = placed.where(inner).select(*columns).unionByName(across)
    blank = ~F.col("element").rlike(r"\S")
    return found.where(~(F.col("may_be_blank") & blank)).select("file_ord", "pos", "element")


def _cut(container: str) -> Callable:
    """Elements, and pieces of elements, of blocks whose state at the beginning is known."""
    close = {"[": "]", "{": "}"}[container]

    def lines(row: dict, text: str) -> list[str]:
        depth, start, found = row["depth"], 0, []
        at = _REST_OF_STRING.match(text).end() if row["in_string"] else 0
        for token in _TOKEN.finditer(text, at):
            kind = text[token.start()]
            depth += (kind in "[{") - (kind in "]}")
            if kind == "\n" and depth == 0:
                found.append(text[start : token.start()])
                start = token.end()
        return [*found, text[start:]]

    def boxed(row: dict, text: str) -> list[str]:
        depth, start, found = row["depth"], 0, []
        if row["number"] == 1:
            start, depth = text.index(container) + 1, 1
        elif depth == 0 and not row["in_string"]:  # the container has been closed before
            if text.strip():
                raise MalformedFile(f"malformed file: text after its end: {row['file']}")
            return []
        at = _REST_OF_STRING.match(text).end() if row["in_string"] else start
        for token in _TOKEN.finditer(text, at):
            kind = text[token.start()]
            depth += (kind in "[{") - (kind in "]}")
            if kind == "," and depth == 1:
                found.append(text[start : token.start()])
                start = token.end()
            elif depth == 0:
                if kind != close or text[token.end() :].strip():
                    raise MalformedFile(f"malformed file: text after its end: {row['file']}")
                return [*found, text[start : token.start()]]
        return [*found, text[start:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "number", "boxed", "local", "n_local", "element"]
        kinds = (pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.string())
        for batch in batches:
            for row in batch.to_pylist():
                text = row["text"][:-1] if row["trim"] else row["text"]
                in_box = row["opens"] == container
                if container == "{" and not in_box and row["opens"] is not None:
                    raise MalformedFile(f"malformed file: no object: {row['file']}")
                found = boxed(row, text) if in_box else lines(row, text)
                n = len(found)
                columns = [[row["file"]] * n, [row["number"]] * n, [in_box] * n, range(n), [n] * n, found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
                )

    return run


def parsed(items: DataFrame, schema: str, as_row: Callable[[str], dict]) -> DataFrame:
    """``(file_ord, pos, ...)`` with the columns of ``schema`` from each element's text.

    ``as_row`` makes a dictionary of one element and raises where it is not of the expected form;
    so does a value of another type than its column.
    """
    fields = StructType.fromDDL(schema)
    out = StructType.fromDDL("file_ord long, pos long")
    for field in fields:
        out = out.add(field)
    kind = pa.struct(list(to_arrow_schema(fields)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(2).to_pylist():
                try:
                    rows.append(as_row(text))
                except ValueError as error:
                    raise MalformedFile(f"malformed file: {error}: {text[:200]!r}") from error
            columns = pa.array(rows, kind).flatten()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *columns], [f.name for f in out]
            )

    return items.select("file_ord", "pos", "element").mapInArrow(run, out)


def objects_with(*required: str, plain: str | None = None) -> Callable[[str], dict]:
    """Elements that are objects with these keys; or, for ``plain``, strings that stand for it."""

    def as_row(text: str) -> dict:
        value = json.loads(text)
        if plain is not None and isinstance(value, str):
            return {plain: value}
        if not isinstance(value, dict) or any(key not in value for key in required):
            raise ValueError(f"no object with {', '.join(required)}")
        return value

    return as_row


def pair(text: str) -> dict:
    """One entry of an object, as its key and value."""
    [(key, value)] = json.loads(f"{{{text}}}").items()
    return {"key": key, "value": value}
