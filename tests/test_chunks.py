import math
import random
import re

import pytest

from corpusflow.config import ChunkSizes
from corpusflow.operators import chunks
from corpusflow.plans.pipelines import build_chunks

PAGES = (
    "page_ord bigint, source_url string, title string, "
    "sections array<struct<section_title: string, text: string>>"
)
CHUNKS = (
    "id string, content string, source_url string, title string, section string, "
    "chunk_index int, page_ord bigint, section_index int"
)
SECTIONS = (
    "page_ord bigint, source_url string, title string, section_index int, "
    "section_title string, text string"
)


def test_clean_sections_renumbers(spark):
    df = spark.createDataFrame(
        [
            (0, "u", "T", [(" A ", "<b>Enough text here</b>"), ("B", "short"), ("C", "1234567890 11"),
                           ("D", "Utviklet av noen"), ("E", "More than enough text")]),
            (1, "v", None, [("X", "no")]),
        ],
        PAGES,
    )
    rows = chunks.clean_sections(df).orderBy("page_ord", "section_index").collect()
    assert [(r.page_ord, r.section_index, r.section_title, r.text) for r in rows] == [
        (0, 0, "A", "Enough text here"), (0, 1, "E", "More than enough text"),
    ]


def words(n, last="w"):
    return " ".join(["w"] * (n - 1) + [last]) + "."


def model_fold(text, sizes):
    """Sequential model, with lists of sentences as state."""

    def tokens(s):
        return math.ceil(len(s.split()) * 1.3)

    def valuable(s):
        return bool(re.search("[0-9]|" + "|".join(map(re.escape, sizes.valuable_words)), s, re.I))

    def tail(sentences):
        kept, total = [], 0
        for s in reversed(sentences):
            if total + tokens(s) > sizes.overlap_tokens:
                break
            kept.insert(0, s)
            total += tokens(s)
        return kept

    sentences = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s]
    out, current = [], []
    for i, sentence in enumerate(sentences):
        total = sum(map(tokens, current))
        if current and total + tokens(sentence) > sizes.max_tokens:
            joined = " ".join(current)
            n = tokens(joined)
            if n >= sizes.min_tokens or (n >= sizes.valuable_min_tokens and valuable(joined)):
                out.append(joined)
            current = tail(current)
        current = [*current, sentence]
        total = sum(map(tokens, current))
        if sizes.min_tokens <= total <= sizes.max_tokens and i + 1 < len(sentences):
            if total + tokens(sentences[i + 1]) > sizes.max_tokens:
                out.append(" ".join(current))
                current = tail(current)
    if current:
        joined = " ".join(current)
        n = tokens(joined)
        if n >= sizes.min_tokens or not out or (n >= sizes.valuable_min_tokens and valuable(joined)):
            out.append(joined)
    return out


def made(spark, texts, sizes=ChunkSizes(), parts=3):
    df = spark.createDataFrame(
        [(i, "https://a.no/X", None, 0, "", text) for i, text in enumerate(texts)], SECTIONS
    ).repartition(parts)
    found = {i: [] for i in range(len(texts))}
    for r in chunks.make_chunks(df, sizes, 0).orderBy("page_ord", "chunk_index").collect():
        assert r.chunk_index == len(found[r.page_ord])
        found[r.page_ord].append(r.content)
    return [found[i] for i in range(len(texts))]


def test_fold_matches_model(spark):
    rng = random.Random(5)
    sizes = ChunkSizes(min_tokens=20, max_tokens=60, overlap_tokens=12, valuable_min_tokens=10)
    texts = []
    for _ in range(400):
        sentences = [
            words(rng.choice([1, 2, 3, 5, 8, 15, 40, 60]), rng.choice(["w", "7", "pris", "ord"]))
            for _ in range(rng.randint(1, 25))
        ]
        texts.append(rng.choice(["  ", " "]).join(sentences))
    expected = [model_fold(text, sizes) for text in texts]
    assert made(spark, texts, sizes) == expected
    assert made(spark, texts, sizes, parts=1) == expected
    assert sum(map(len, expected)) > 800


@pytest.mark.parametrize(
    ("text", "n"),
    [
        (words(60) + " " + words(1000), 1),             # first part too small: lost
        (words(60, "7") + " " + words(1000), 2),        # kept for its digit
        (words(1500), 1),                               # a long sentence is never split
        (words(900) + " " + words(30), 1),              # tail of 39 tokens lost
        (words(900) + " " + words(39, "7"), 2),         # tail of 51 with a digit
        (words(900) + " " + words(77), 2),              # tail of 101
    ],
)
def test_fold_edges(spark, text, n):
    found = made(spark, [text])[0]
    assert found == model_fold(text, ChunkSizes())
    assert len(found) == n


def test_short_sections_are_skipped_and_ids_built(spark):
    rows = [
        (0, "http://A.no/x?y", "T", 0, "Om oss!", "x" * 49),
        (0, "http://A.no/x?y", "T", 1, "Om oss!", "x" * 50),
        (1, "a.no/https://b", None, 0, "", "y" * 50),
    ]
    found = chunks.make_chunks(spark.createDataFrame(rows, SECTIONS)).orderBy("page_ord").collect()
    assert [r.id for r in found] == ["a-no-x-y-om-oss--1-0", "a-no-b-untitled-0-0"]
    assert found[1].section == "" and found[0].section == "Om oss!"


def classify(spark, content, section="", title=None):
    df = spark.createDataFrame([("i", content, "u", title, section, 0, 0, 0)], CHUNKS)
    return chunks.classify_chunks(df).first().reason


LONG = "ord som betyr noe i en vanlig setning her på norsk uten noe spesielt i seg"


@pytest.mark.parametrize(
    ("content", "section", "title", "reason"),
    [
        ("Følg oss", "", None, "navigation/UI"),
        ("meny header footer " + LONG, "", None, "navigation/UI"),
        ("meny header " + LONG, "", None, None),
        ("meny header " + LONG, "Footer", None, "navigation/UI"),
        ("meny header footer pris " + LONG, "", None, None),
        ("ÅPENT meny header footer " + LONG, "", None, None),
        ("Les mer om dette", "", None, "navigation/UI"),
        (LONG, "Cookies", None, "consent/legal"),
        (LONG, "", "Personvern", "consent/legal"),
        ("cookie 7 " + "x" * 91, "", None, "consent/legal"),     # length 100
        ("cookie 7 " + "x" * 92, "", None, "too short"),         # length 101
        ("a b c d e f g h i j k l m n", "", None, "too short"),
        ("a b c d e f g h i j k l m n o.", "", None, "fragmented language"),
        (LONG + ". Dette.", "", None, "fragmented language"),
        ("en to. tre fire! fem seks? syv åtte. ni ti. elleve tolv. tretten f. g h", "", None,
         "fragmented language"),
        (LONG + " [ ]", "", None, "fragmented language"),
        ("a b c d e f g h i j k l m n o", "", None, "low quality"),
        ("a b c d e f g h i j k l m n 1", "", None, None),
        (LONG, "", None, None),
    ],
)
def test_reasons(spark, content, section, title, reason):
    assert classify(spark, content, section, title) == reason


def model_dedup(rows):
    seen, out = set(), []
    for content, reason in rows:
        norm = re.sub("[.,!?;:]", "", re.sub(r"\s+", " ", content.lower().strip()))
        if reason in (None, chunks.LOW_QUALITY):
            if norm in seen:
                reason = chunks.DUPLICATE
            elif reason is None:
                seen.add(norm)
        out.append(reason)
    return out


def test_dedup_matches_sequential_model(spark):
    rng = random.Random(11)
    rows = [
        (
            rng.choice(["A b", "a  b.", "c!", " C", "d", "hot", "HOT,", "hot hot"]),
            rng.choice([None, None, chunks.LOW_QUALITY, chunks.TOO_SHORT]),
        )
        for _ in range(3000)
    ]
    df = spark.createDataFrame(
        [
            ("i", content, "u", None, "", i % 3, i // 9, (i // 3) % 3, reason)
            for i, (content, reason) in enumerate(rows)
        ],
        CHUNKS + ", reason string",
    ).repartition(7)
    expected = model_dedup(rows)
    for hot_rows in (0, 500, 10**6):
        tagged = (
            chunks.dedup_chunks(df, hot_rows)
            .orderBy("page_ord", "section_index", "chunk_index").collect()
        )
        assert [r.reason for r in tagged] == expected
    kept = chunks.keep_first_chunks(df).collect()
    assert len(kept) == expected.count(None)
    assert {(r.page_ord, r.section_index, r.chunk_index) for r in kept} == {
        (r.page_ord, r.section_index, r.chunk_index) for r in tagged if r.reason is None
    }


def test_report(spark):
    pages = spark.createDataFrame(
        [(0, "u", None, [("A", LONG), ("B", "kort")]), (1, "v", None, [("C", LONG)]),
         (2, "w", None, [("D", "kort")])],
        PAGES,
    )
    cleaned = chunks.clean_sections(pages)
    tagged = chunks.dedup_chunks(chunks.classify_chunks(chunks.make_chunks(cleaned)))
    report = chunks.cleaning_report(pages, cleaned, tagged).first().asDict()
    assert report == {
        "pages_before": 3, "sections_before": 4, "pages_after": 2, "sections_after": 2,
        "chunks_created": 2, "chunks_kept": 1, "navigation": 0, "consent": 0, "too_short": 0,
        "duplicates": 1, "fragmented": 0, "chunks_removed": 1, "removed_pct": 50.0,
    }
    empty = chunks.cleaning_report(pages, cleaned, tagged.where("false")).first()
    assert empty.removed_pct is None and empty.chunks_created == 0
    assert [r.content for r in build_chunks(pages).collect()] == [LONG]
