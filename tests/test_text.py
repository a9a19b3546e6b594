import random

import pytest
from pyspark.sql import functions as F

from corpusflow.functions import text as t


def apply(spark, rule, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", rule(F.col("v")).alias("o")).orderBy("i").collect()]


def test_whitespace_includes_unicode_spaces(spark):
    assert apply(spark, t.trim_ws, "   a b﻿ ", "　\n") == ["a b", ""]
    assert apply(spark, t.collapse_ws, "a  \n\tb", "a﻿b") == ["a b", "a b"]
    assert apply(spark, t.word_count, " a  b﻿c ", "", None, "  ") == [3, 0, 0, 0]


def test_token_estimates(spark):
    assert apply(spark, t.chunk_tokens, "a b c", "", "a " * 10) == [4, 0, 13]
    assert apply(spark, t.chat_tokens, "abcd", "abcde", "") == [1, 2, 0]


def model_truncate(text, tokens):
    limit = tokens * 4
    if len(text) <= limit:
        return text
    head = text[:limit]
    end = max(head.rfind(m) for m in ".!?")
    if end > limit * 0.7:
        return text[: end + 1]
    space = head.rfind(" ")
    if space > limit * 0.8:
        return text[:space] + "..."
    return head + "..."


def test_truncation_matches_model(spark):
    rng = random.Random(3)
    rows = [
        ("".join(rng.choice("abcd .!?é") for _ in range(rng.randint(0, 400))), rng.randint(50, 90))
        for _ in range(500)
    ]
    df = spark.createDataFrame(
        [(i, text, n) for i, (text, n) in enumerate(rows)], "i int, text string, n bigint"
    )
    cut = df.select("i", t.truncate_to_tokens(F.col("text"), F.col("n")).alias("o"))
    got = [r.o for r in cut.orderBy("i").collect()]
    assert got == [model_truncate(*row) for row in rows]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("a ! b", "a! b"),
        ("a . . b", "a.. b"),
        ("a .. b", "a .. b"),
        ("x. .. y", "x... y"),
        ("x. !", "x.!"),
        ("a !", "a !"),
        (". a", ". a"),
        ("&amp;lt;b", "<b"),
        ("<p>a</p>&nbsp;b", "a b"),
        ("![alt](u) [text](u)", "!alt text"),
        ("[a] [b](u) \\[x\\]", "a b \\x\\"),
        ("# Title\n- item\n1. first\n> quote\n---\nend", "Title item first quote end"),
        ("**bold** *it* __b__ _i_ `code`", "bold it b i"),
        ("see (https://a.b/c) now", "see now"),
    ],
)
def test_section_cleaning(spark, text, expected):
    assert apply(spark, t.clean_section_text, text) == [expected]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Intro\n- one\n2. two!\n* three", "Intro one. three. two!"),
        ("text", "text."),
        ("done?", "done?"),
        ("", ""),
        ("```\ncode\n```\nafter", "after."),
        ("[![img](a)](b) x", "[](b) x."),
        ("## H\n**b**", "H b."),
    ],
)
def test_markdown_to_plain(spark, text, expected):
    assert apply(spark, t.markdown_to_plain, text) == [expected]


def test_page_text_drops_urls(spark):
    assert apply(spark, t.clean_page_text, "Mail a@b.no, www.x.no/y or https://x.no/z) end") == [
        "Mail a@b.no, or ) end"
    ]
