import hashlib

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusflow.llm import infill, queries

SF = "/root/testdata/sf0.001"


def plain_cut(key, text, unit=None):
    """The contract, one text at a time."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    if unit is None:
        units = list(text)
    else:
        units, at = [], 0
        for m in regex.finditer(unit, text):
            if m.end() > m.start():
                units.append(text[at : m.end()])
                at = m.end()
        units += [text[at:]] if at < len(text) else []
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in infill.MARKS) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    parts = ["".join(units[:a]), "".join(units[a:b]), "".join(units[b:])]
    if h4 % 100 < 20:
        out = f"<S>{parts[2]}<P>{parts[0]}<M>{parts[1]}"
        return n, "spm", len(parts[0]), len(parts[1]), out
    return n, "psm", len(parts[0]), len(parts[1]), f"<P>{parts[0]}<S>{parts[2]}<M>{parts[1]}"


@settings(max_examples=200, deadline=None)
@given(widths=st.lists(st.integers(1, 9), max_size=3000))
def test_ranks_are_found_at_their_place(widths):
    units = infill.SkipList(np.array(widths, np.int64))
    ends = np.concatenate([[0], np.cumsum(widths)])
    for rank in {0, 1, len(widths) // 3, len(widths) - 1, len(widths)}:
        if 0 <= rank <= len(widths):
            assert units.points_before(rank) == ends[rank]
    with pytest.raises(IndexError):
        units.points_before(len(widths) + 1)


def test_lanes_thin_out_and_descent_is_short():
    units = infill.SkipList(np.ones(1_000_000, np.int64))
    sizes = [len(lane.units) for lane in units.lanes]
    assert len(sizes) < 12 and all(b < a / 4 for a, b in zip(sizes, sizes[1:], strict=False))
    assert all(lane.units.sum() == 1_000_000 == lane.points.sum() for lane in units.lanes)
    # The longest run between two nodes of the next lane bounds the steps in a lane.
    assert max(np.diff(np.append(lane.below, below)).max() for lane, below in zip(units.lanes[1:], sizes, strict=False)) < 200
    assert [units.points_before(r) for r in (0, 1, 999_999, 1_000_000)] == [0, 1, 999_999, 1_000_000]


TEXTS = ["", None, "a", "ab", "héllo wörld 🙂 é and more", "with <P> inside", "<S>", "<M>x", "\n\n \t", "<<P", "x" * 5000]


@pytest.mark.parametrize("unit", [None, r"\w+|\s+", r"\n", r"z*"])
def test_equal_to_one_text_at_a_time(spark, unit):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(150)] + [(None, "no key"), (3, TEXTS[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cut = infill.fill_in_middle(df, unit=unit).withColumn("back", infill.restored("output", "form"))
    got = sorted(map(repr, ((r["doc_id"], r["n_units"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in cut.collect())))
    assert got == sorted(repr((k, *plain_cut(k, t, unit))) for k, t in rows)
    assert all(r["back"] == (r["text"] or "") for r in cut.collect())
    assert {r["form"] for r in cut.collect()} == {"plain", "psm", "spm"}


def test_marks_that_can_be_misread_raise(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for marks in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("aa", "b", "c"), ("xy", "yz", "c"), ("a", "xax", "c")):
        with pytest.raises(ValueError):
            infill.fill_in_middle(df, marks=marks)


def test_query_equals_one_text_at_a_time(spark):
    texts = {r["doc_id"]: r["text"] for r in queries.documents(spark, SF).collect()}
    rows = queries.op13_fill_in_middle(spark, SF).collect()
    assert len(rows) == len(texts)
    for row in rows:
        n, form, prefix, middle, output = plain_cut(row["doc_id"], texts[row["doc_id"]])
        assert (row["n"], row["form"], row["prefix_chars"], row["middle_chars"]) == (n, form, prefix, middle)
        assert row["output_sha256"] == hashlib.sha256(output.encode()).hexdigest()
        assert row["restored_sha256"] == hashlib.sha256((texts[row["doc_id"]] or "").encode()).hexdigest()
