import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusflow.llm import queries, substrings, suffixes


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=80), st.integers(1, 4))
def test_suffix_array_and_prefixes(values, times):
    text = values * times
    order = suffixes.suffix_array(np.array(text, np.int64))
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    prefixes = suffixes.common_prefixes(np.array(text, np.int64), order, 20)
    for before, place in zip(order.tolist(), order.tolist()[1:]):
        n = 0
        while (
            n < 20 and max(before, place) + n < len(text)
            and text[before + n] == text[place + n] != 0
        ):
            n += 1
        assert prefixes[place] == n


def brute(rows, width):
    """Rows with distinct ids, in any order."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - width + 1):
            piece = data[k : k + width]
            if piece in seen:
                gone[k : k + width] = b"\1" * width
            seen.add(piece)
        kept = bytes(c for c, g in zip(data, gone) if not g)
        spans = sum(g and not gone[k - 1] if k else g for k, g in enumerate(gone))
        out[doc] = (len(data), sum(gone), spans, kept)
    return out


def found(df, width):
    return {
        r["doc_id"]: (
            r["n_bytes"],
            sum(s["end"] - s["start"] for s in r["spans"]),
            len(r["spans"]),
            bytes(r["kept"]),
        )
        for r in substrings.repeated_substrings(df, width=width).collect()
    }


@pytest.mark.parametrize("hot,width", [(15_000, 100), (1, 100), (3, 40)])
def test_equals_brute_force(spark, monkeypatch, hot, width):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "CHUNK", 3000)
    monkeypatch.setattr(substrings, "SHARD", 4000)
    monkeypatch.setattr(substrings, "VALUES_PER_RANGE", 64)
    rnd = random.Random(7)
    words = ["w%d" % k for k in range(300)] + ["été", "ñandú", "a"]
    passages = [" ".join(rnd.choice(words) for _ in range(30)) for _ in range(6)]
    rows = []
    for doc in range(120):
        parts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(30)))]
        for _ in range(rnd.randrange(3)):
            parts += [rnd.choice(passages)[rnd.randrange(60) :], rnd.choice(words)]
        rows.append((doc, " ".join(parts)))
    rows += [(200, "ab" * 200), (201, "ab" * 150), (202, "x" * 99), (203, "x" * 100), (204, "x" * 300)]
    rows += [(300 + k, rows[k][1]) for k in range(20)] + [(400, None), (401, ""), (None, rows[0][1])]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(df, width) == brute(rows, width)


def test_rows_with_one_id_do_not_remove_each_other(spark):
    text = " ".join("w%d" % k for k in range(100))
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    out = substrings.repeated_substrings(df).collect()
    assert sorted((r["doc_id"], len(r["spans"])) for r in out) == [(1, 0), (1, 0), (2, 1)]


def test_query_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in queries.documents(spark, sf_dir).collect()]
    wanted = {
        doc: (n, gone, spans, hashlib.sha256(kept).hexdigest())
        for doc, (n, gone, spans, kept) in brute(rows, 100).items()
    }
    out = queries.op4_substring_dedup(spark, sf_dir).collect()
    assert {r[0]: tuple(r[1:]) for r in out} == wanted
