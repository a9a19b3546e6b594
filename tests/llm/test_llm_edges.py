"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusflow.llm import (
    bpe,
    decontaminate,
    infill,
    language,
    media,
    near,
    pieces,
    pii,
    quality,
    secrets,
    substrings,
)

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
CONTENT = {"aa": b"abba aba baab abab " * 20, "bb": b"xyz zyx yxz xzy " * 20}
LONG = "lorem ipsum dolor sit amet " * 20_000
ROWS = [
    (1, "abba aba baab", "aa"),
    (2, None, None),
    (3, "", "aa"),
    (4, LONG, "bb"),
    (1, "abba aba baab", "aa"),
    (None, "abba aba baab", None),
    (5, " \n\t ", "bb"),
    (6, "12 34 ...", "bb"),
]


def items(spark):
    return spark.createDataFrame(
        [(1, "abba aba baab"), (2, None), (3, ""), (None, "x y z"), (1, "abba aba baab")],
        "item_id long, text string",
    )


OPERATORS = {
    "encode": lambda spark, df: bpe.decode(bpe.encode(df, WORDS), WORDS),
    "both": lambda spark, df: bpe.encode_and_decode(df, WORDS),
    "count": lambda spark, df: bpe.count_tokens(df, WORDS),
    "media": lambda spark, df: media.payload(media.inspect(media.store(df))),
    "secrets": lambda spark, df: secrets.scan_secrets(df),
    "language": lambda spark, df: language.identify(df, CONTENT),
    "pii": lambda spark, df: pii.pseudonymize(df, "key"),
    "leaks": lambda spark, df: decontaminate.find_leaks(df, items(spark)),
    "near": lambda spark, df: near.near_duplicates(df),
    "quality": lambda spark, df: quality.score(df, quality.fit(df)),
    "pieces": lambda spark, df: pieces.encode(df, PIECES, decoded="decoded"),
    "infill": lambda spark, df: infill.fill_in_middle(df),
    "substrings": lambda spark, df: substrings.repeated_substrings(df),
}
RESULTS = {
    "encode": ["ids", "decoded"],
    "both": ["ids", "decoded"],
    "count": ["n_tokens"],
    "media": ["media", "info", "payload"],
    "secrets": ["secrets"],
    "language": ["lang_pred", "score", "rejected"],
    "pii": ["pii"],
    "leaks": ["leaks"],
    "near": ["n_shingles", "component_id", "kept"],
    "quality": ["quality_score", "kept", "n_words"],
    "pieces": ["ids", "decoded"],
    "infill": ["form", "n_units", "prefix_chars", "middle_chars", "output"],
    "substrings": ["n_bytes", "spans", "kept"],
}


def table(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_keep_their_place(spark, name):
    out = OPERATORS[name](spark, table(spark)).collect()
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out)
    assert ids == sorted((i is None, i or 0) for i, _, _ in ROWS)
    same = [tuple(r[c] for c in RESULTS[name]) for r in out if r["doc_id"] == 1]
    assert len(same) == 2 and same[0] == same[1]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    out = OPERATORS[name](spark, table(spark, []))
    assert out.collect() == []
    assert set(RESULTS[name]) <= set(out.columns)


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_are_replaced(spark, name):
    rows = table(spark, [(1, "abba aba baab", "aa"), (2, "xyz zyx", "bb")])
    plain = {r["doc_id"]: r for r in OPERATORS[name](spark, rows).collect()}
    clash = rows.select("*", *[F.lit("x").alias(c.upper()) for c in RESULTS[name]])
    for row in OPERATORS[name](spark, clash).collect():
        for column in RESULTS[name]:
            assert row[column] == plain[row["doc_id"]][column]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_stand_odd_rows(spark, tmp_path, name, stage):
    items(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(*row, "s", 3) for row in ROWS] + [(None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        out = stage(spark, docs, str(tmp_path))
        assert out.columns[:5] == docs.columns
        assert out.count() <= len(given)


# Names that operators or stages use, or used, for columns of passage.
PASSAGE = ["_id", "_hits", "_new", "_pred", "_score", "_rejected", "_pii", "_leaks", "ids", "decoded", "n_tokens"]


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_of_passage_of_the_same_name_pass_through(spark, name):
    rows = table(spark, [(1, "abba aba baab", "aa"), (2, "xyz zyx", "bb")])
    names = [n for n in PASSAGE if n not in RESULTS[name]]
    extra = rows.select("*", *[F.lit(f"own {n}").alias(n) for n in names])
    out = OPERATORS[name](spark, extra)
    if name == "substrings":  # returns its own columns only
        assert out.count() == 2
        return
    for row in out.collect():
        assert all(row[n] == f"own {n}" for n in names)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_with_clashing_columns(spark, tmp_path, name, stage):
    items(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(
        [(*row, "s", 3) for row in ROWS],
        "doc_id long, text string, lang string, source string, n_chars long",
    ).select("*", *[F.lit(f"own {n}").alias(n) for n in PASSAGE])
    stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out"))
    made = {"ids", "n_tokens", "decoded_sha256"} if name == "encode_texts" else set()
    for row in out.collect():
        assert all(row[n] == f"own {n}" for n in PASSAGE if n not in made)
