import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusflow.llm import pieces, queries

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
ODD = ["▁", "  ", "<s>", "</s>", "<unk>", "<0x41>", "\x00", "\n", "日本", "🙂", "é", "’s", "...", "12,5", "ﷺ", "²."]
TEXTS = st.lists(st.one_of(st.sampled_from(ODD), st.text(max_size=10)), max_size=8).map("".join)


def ids_of(text):
    known = pieces.model(PATH)
    return [i for c in known.chunks(text) for i in known.segment(c)] + [known.end]


@settings(max_examples=500, deadline=None)
@given(text=TEXTS)
def test_ids_and_texts_equal_the_library(text):
    ids = ids_of(text)
    assert ids == LIBRARY.encode(text, add_eos=True)
    assert pieces.model(PATH).text_of(ids) == LIBRARY.decode(ids)


@settings(max_examples=300, deadline=None)
@given(ids=st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31_999)), max_size=10))
def test_any_ids_decode_like_the_library(ids):
    assert pieces.model(PATH).text_of(ids) == LIBRARY.decode(ids)


@pytest.mark.parametrize("text", ["x" * 3000, " " * 999 + "a", "ab" * 2000, "日" * 500, "." * 700, "a\n" * 300])
def test_long_chunks(text):
    assert ids_of(text) == LIBRARY.encode(text, add_eos=True)


def test_both_ways_of_merging_agree():
    known = pieces.model(PATH)
    for chunk in ("▁tokenization", "▁▁▁▁▁▁▁", "▁▁▁the", "internationalisation", "aaaaaaaaaaaa"):
        symbols = [known.ids.get(c, -1) for c in chunk]
        assert known._short(list(symbols)) == known._long(list(symbols))


@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_packed_numbers(numbers):
    packed = pieces.packed_numbers(np.array(numbers, np.uint32))
    assert pieces.unpacked_numbers(packed).tolist() == numbers


def rows_of(df):
    return sorted(((r["doc_id"], list(r["ids"]), r["decoded"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block_chunks,shard_entries", [(1, 1), (7, 5), (500_000, 600_000)])
def test_blocks_and_shards_change_nothing(spark, monkeypatch, block_chunks, shard_entries):
    # The number of shards is chosen here; block limits are read by the workers' own module.
    monkeypatch.setattr(pieces, "SHARD_ENTRIES", shard_entries)
    texts = ["", None, "the cat sat", "the  cat", " cat.", "12,5 %", "日本 🙂", "a\n\nb"]
    rows = [(i % 9, texts[i % len(texts)]) for i in range(40)] + [(None, "no key"), (1, "x " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = rows_of(pieces.encode(df, PATH, decoded="decoded", keep_text=False))
    want = [(k, LIBRARY.encode(t or "", add_eos=True)) for k, t in rows]
    assert got == sorted(((k, ids, LIBRARY.decode(ids)) for k, ids in want), key=repr)


def test_blocks_end_when_they_are_full():
    block = pieces.Block()
    block.add(["a", "b", "a"], pieces.BLOCK_BYTES)
    assert block.full and pieces.unpacked_numbers(block.coded[0]).tolist() == [0, 1, 0]
    data, lengths, order = block.listed()
    assert sorted(pieces.cut_apart(data, pieces.unpacked_numbers(lengths))) == [b"a", b"b"]
    assert sorted(pieces.unpacked_numbers(order).tolist()) == [0, 1]


def test_decode_by_itself_and_unknown_ids(spark):
    df = spark.createDataFrame([(1, [450, 6635, 2]), (2, None), (3, [])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["decoded"] for r in pieces.decode(df, PATH).collect()}
    assert got == {1: LIBRARY.decode([450, 6635, 2]), 2: "", 3: ""}
    bad = spark.createDataFrame([(1, [32_000])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="vocabulary"):
        pieces.decode(bad, PATH).collect()


def test_query_equals_the_library(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in queries.documents(spark, SF).collect()}
    rows = queries.op12_piece_codec(spark, SF).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = LIBRARY.encode(texts[row["doc_id"]], add_eos=True)
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
