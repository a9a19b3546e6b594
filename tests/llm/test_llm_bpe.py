import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusflow.llm import bpe, queries

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ODD = ["<|endoftext|>", "<|startoftext|>", "don't  ", "Σ", "İx", "\x1c\x85", "é", "١２½", "\n\n \t"]
TEXTS = st.lists(st.one_of(st.sampled_from(ODD), st.text(max_size=12)), max_size=8).map("".join)


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def encoded(name, text):
    vocab = bpe.vocabulary(public_tokenizers.path(name))
    ids = []
    for piece in vocab.pieces(text):
        special = vocab.special.get(piece)
        ids += [special] if special is not None else bpe.merged(vocab.symbols(piece), vocab)
    return vocab, ids


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=400, deadline=None)
@given(text=TEXTS)
def test_ids_and_counts_equal_the_library(name, text):
    vocab, ids = encoded(name, text)
    assert ids == library_cached(name).encode(text, add_special_tokens=False).ids
    count = bpe._counted_words(public_tokenizers.path(name))
    assert sum(count[p] for p in vocab.pieces(text)) == len(ids)


_KNOWN = {}


def library_cached(name):
    return _KNOWN.setdefault(name, library(name))


@settings(max_examples=100, deadline=None)
@given(text=st.text(max_size=60))
def test_byte_vocabulary_round_trip(text):
    vocab, ids = encoded("byte_bpe_50k.json", text)
    assert b"".join(bpe.bytes_of(vocab.strings[i]) for i in ids) == text.encode("utf-8")


def test_long_words_and_runs():
    for text in ("x" * 5000, " " * 999 + "a", "ab" * 3000):
        for name in FILES:
            assert encoded(name, text)[1] == library_cached(name).encode(text, add_special_tokens=False).ids


def code_points():
    import unicodedata

    kept = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    return [c for c in kept if c < 0x20000 or unicodedata.category(chr(c)) not in ("Cn", "Co")]


@pytest.mark.parametrize("name", FILES)
@pytest.mark.parametrize("context", ["a{0}b {0} x{0}", "{0}\u0301 \u0301{0} {0}\u0323\u0307 A\u0327{0}"])
def test_every_code_point_equals_the_library(name, context):
    """Every code point but private and unassigned ones of the far planes, also beside marks."""
    points = code_points()
    texts = [context.format(chr(c)) for c in points]
    different = []
    for start in range(0, len(texts), 20_000):
        part = texts[start : start + 20_000]
        for c, text, wanted in zip(
            points[start:], part, library_cached(name).encode_batch(part, add_special_tokens=False)
        ):
            if encoded(name, text)[1] != wanted.ids:
                different.append(hex(c))
    assert different == []


def test_every_composition_equals_the_library():
    import unicodedata

    for c in code_points():
        parts = unicodedata.decomposition(chr(c))
        if parts and "<" not in parts:
            for text in (unicodedata.normalize("NFD", chr(c)), "".join(chr(int(x, 16)) for x in parts.split())):
                text = f"a{text}b {text}"
                wanted = library_cached(FILES[1]).encode(text, add_special_tokens=False).ids
                assert encoded(FILES[1], text)[1] == wanted, hex(c)


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.characters(max_codepoint=255), max_size=20))
def test_texts_below_256_split_alike(text):
    for name in FILES:
        vocab = bpe.vocabulary(public_tokenizers.path(name))
        lowered = text.lower() if vocab.folds else text
        assert vocab.narrow.findall(lowered) == vocab.pattern.findall(lowered)


def test_queries_equal_the_library(spark):
    import hashlib

    sf_dir = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in queries.documents(spark, sf_dir).collect()}
    words, data = library_cached(FILES[1]), library_cached(FILES[0])
    for row in queries.op3_bpe_codec(spark, sf_dir).collect():
        ids = words.encode(texts[row["doc_id"]], add_special_tokens=False).ids
        back = words.decode(ids, skip_special_tokens=False)
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()
    for row in queries.op6_token_counts(spark, sf_dir).collect():
        text = texts[row["doc_id"]]
        n = len(data.encode(text, add_special_tokens=False).ids)
        assert (row["n_bytes"], row["n_tokens"]) == (len(text.encode()), n)
        assert row["over_limit"] == (n > 512)


def test_cache_forgets_and_stays_right():
    made = []
    cache = bpe.Generations(lambda k: made.append(k) or k * 2, limit=3)
    assert [cache[k] for k in (1, 2, 3, 4, 1, 5, 6, 7, 8, 9, 1)] == [2, 4, 6, 8, 2, 10, 12, 14, 16, 18, 2]
    assert len(cache) <= 3
