import random

import numpy as np
import pytest

from corpusflow.llm import decontaminate, queries

VOCABULARY = ["v%d" % k for k in range(3000)] + ["the", "of", "and"] * 200


def text_of(rnd, n):
    return " ".join(rnd.choice(VOCABULARY) for _ in range(n))


def edited(rnd, text, edits):
    words = text.split()
    for _ in range(edits):
        k = rnd.randrange(len(words))
        kind = rnd.randrange(3)
        if kind == 0:
            words[k] = "changed"
        elif kind == 1:
            words.insert(k, "added")
        else:
            del words[k]
    return " ".join(words)


def plain_distance(a, b):
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_edit_distance_equals_plain_form():
    rnd = np.random.default_rng(3)
    for _ in range(200):
        a, b = (rnd.integers(0, 4, rnd.integers(1, 15)).astype(np.uint64) for _ in range(2))
        assert decontaminate.edit_distance(a, b)[0] == plain_distance(a.tolist(), b.tolist())


def test_recall_of_edited_passages_and_no_false_ones():
    rnd = random.Random(5)
    items = [text_of(rnd, rnd.randrange(8, 90)) for _ in range(150)]
    block = decontaminate.Items(list(range(150)), items, decontaminate.MAX_EDITS)
    docs, wanted = [], []
    for k, item in enumerate(items):
        for share in (0, 0.05, 0.1, 0.15):
            inside = edited(rnd, item, int(share * len(item.split())))
            docs.append(f"{text_of(rnd, rnd.randrange(40))} {inside.title()}, {text_of(rnd, 20)}")
            wanted.append(k)
        docs.append(text_of(rnd, 200))
        wanted.append(None)
    found = block.found([decontaminate.words(d) for d in docs])
    hits = [k in f for k, f in zip(wanted, found) if k is not None]
    assert np.mean(hits) > 0.98
    assert all(not f for k, f in zip(wanted, found) if k is None)
    for k, own in zip(wanted, found):
        for item, (edits, _) in own.items():
            assert item == k and edits <= decontaminate.MAX_EDITS * len(items[k].split())


@pytest.mark.parametrize("length", [8, 9, 13, 14, 19, 20, 21, 23, 24, 26, 27, 34, 60])
def test_recall_per_length_and_edits(length):
    rnd = random.Random(length)
    items = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(length)) for _ in range(120)]
    block = decontaminate.Items(list(range(120)), items, decontaminate.MAX_EDITS)
    head = max(8, length // 3)
    for edits in range(int(decontaminate.MAX_EDITS * length) + 1):
        docs = []
        for item in items:
            first, last = " ".join(item.split()[:head]), " ".join(item.split()[head:])
            for inside in (edited(rnd, item, edits), f"{edited(rnd, first, edits)} {last}"):
                docs.append(f"{text_of(rnd, rnd.randrange(40))} {inside} {text_of(rnd, 20)}")
        found = block.found([decontaminate.words(d) for d in docs])
        share = np.mean([k // 2 in f and f[k // 2][0] <= edits for k, f in enumerate(found)])
        assert share >= (1 if length < decontaminate.LONG else decontaminate.RECALL), edits


def test_items_of_few_different_words():
    items = ["yes no " * 4, "yes no " * 20, "na " * 30, "yes no " * 20 + "maybe"]
    block = decontaminate.Items([0, 1, 2, 3], items, decontaminate.MAX_EDITS)
    found = block.found([decontaminate.words(f"so {i} then") for i in items])
    assert [f[k] for k, f in enumerate(found)] == [(0, 1)] * 4
    changed = " ".join(["yes no"] * 9 + ["yes", "changed"] + ["yes no"] * 10)
    (found,) = block.found([decontaminate.words(changed)])
    assert found[1][0] == 1


def test_short_items_must_be_equal(spark):
    docs = spark.createDataFrame(
        [(1, "x alpha beta gamma y"), (2, "alpha beta delta"), (3, "Alpha, beta; GAMMA!")],
        "doc_id long, text string",
    )
    items = spark.createDataFrame([(7, "alpha beta gamma")], "item_id long, text string")
    out = {r["doc_id"]: r["leaks"] for r in decontaminate.find_leaks(docs, items).collect()}
    assert [len(out[k]) for k in (1, 2, 3)] == [1, 0, 1]
    assert out[1][0].asDict() == {"item_id": 7, "edits": 0, "first_word": 1}


def test_blocks_give_the_same(spark, monkeypatch):
    sf_dir = "/root/testdata/sf0.001"
    once = queries.op2_decontamination(spark, sf_dir).collect()
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 300)
    assert sorted(once) == sorted(queries.op2_decontamination(spark, sf_dir).collect())


def test_query_finds_every_verbatim_passage(spark):
    sf_dir = "/root/testdata/sf0.01"
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    docs = queries.documents(spark, sf_dir).collect()
    wanted = {(d["doc_id"], i["item_id"]) for d in docs for i in items if i["text"] in d["text"]}
    out = queries.op2_decontamination(spark, sf_dir).collect()
    assert wanted and {(r["doc_id"], r["item_id"]) for r in out if r["edits"] == 0} >= wanted


def test_query_equals_all_pairs(spark):
    """Every item in every document by edit distance, without windows, keys or parts."""
    sf_dir = "/root/testdata/sf0.001"
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    docs = {r["doc_id"]: decontaminate.words(r["text"]) for r in queries.documents(spark, sf_dir).collect()}
    wanted = {}
    for item in items:
        own = decontaminate.words(item["text"])
        allowed = int(decontaminate.MAX_EDITS * len(own)) if len(own) >= decontaminate.SHORT else 0
        for doc_id, text in docs.items():
            if len(own) and len(text) >= len(own) - allowed:
                edits = decontaminate.edit_distance(own, text)[0]
                if edits <= allowed:
                    wanted[doc_id, item["item_id"]] = edits
    out = {(r["doc_id"], r["item_id"]): r["edits"] for r in queries.op2_decontamination(spark, sf_dir).collect()}
    assert wanted and set(out) == set(wanted)
    assert all(out[k] == wanted[k] for k in out)
