"""Section cleaning, overlap chunking, rule-based chunk filtering and deduplication.

Order is always explicit: ``page_ord``, ``section_index`` and ``chunk_index`` identify a
chunk. The readable ``id`` can collide and is never used as a key.
"""

from __future__ import annotations

import math
import re
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow import config
from corpusflow.config import ChunkRules, ChunkSizes
from corpusflow.functions import text as t
from corpusflow.functions.lineage import HOT_ROWS, lookup, stored

NAVIGATION = "navigation/UI"
CONSENT = "consent/legal"
TOO_SHORT = "too short"
FRAGMENTED = "fragmented language"
DUPLICATE = "duplicate"
LOW_QUALITY = "low quality"

_ORDER = ("page_ord", "section_index", "chunk_index")
_SENTENCE_GAP = rf"(?<=[.!?]){t.WS}+"
_GAP = re.compile(_SENTENCE_GAP)
# Makes str.split() agree with the shared whitespace class.
_AS_PYTHON_SPACES = str.maketrans({"\ufeff": " ", **dict.fromkeys("\x1c\x1d\x1e\x1f\x85", "x")})


# -- cleaning --------------------------------------------------------------------------


def clean_sections(
    pages: DataFrame, meaningless_phrases: tuple[str, ...] = config.MEANINGLESS_PHRASES
) -> DataFrame:
    """One row per cleaned section worth keeping.

    ``pages(page_ord, source_url, title, sections)`` becomes ``(page_ord, source_url,
    title, section_index, section_title, text)``; ``section_index`` counts the sections
    that are left, and a page without any disappears.
    """

    def cleaned(section: Column) -> Column:
        return F.struct(
            t.trim_ws(F.coalesce(section["section_title"], F.lit(""))).alias("section_title"),
            t.clean_section_text(F.coalesce(section["text"], F.lit(""))).alias("text"),
        )

    def worth_keeping(section: Column) -> Column:
        text = section["text"]
        meaningless = (F.length(text) < 50) & t.contains_any(F.lower(text), meaningless_phrases)
        return (F.length(text) >= 10) & text.rlike("[a-zA-ZæøåÆØÅ]") & ~meaningless

    kept = F.filter(F.transform("sections", cleaned), worth_keeping)
    return pages.select(
        "page_ord", "source_url", "title",
        F.posexplode_outer(kept).alias("section_index", "section"),
    ).where(F.col("section").isNotNull()).select(
        "page_ord", "source_url", "title", "section_index",
        F.col("section.section_title").alias("section_title"),
        F.col("section.text").alias("text"),
    )


# -- chunking --------------------------------------------------------------------------


def fold_sentences(text: str, sizes: ChunkSizes) -> list[str]:
    """Chunks of one text: greedy over sentences, with overlap.

    A chunk is always a run of consecutive sentences, so the state is where the run
    starts. Runs that end below the minimum without practical information are lost.
    """
    valuable = re.compile("[0-9]|" + "|".join(map(re.escape, sizes.valuable_words)), re.I)

    def tokens(piece: str) -> int:
        words = len(piece.translate(_AS_PYTHON_SPACES).split())
        return math.ceil(words * config.CHUNK_TOKENS_PER_WORD)

    pieces = _GAP.split(text.strip(t.SPACES))
    sentences = [piece for piece in (p.strip(t.SPACES) for p in pieces) if piece]
    position = [0, *accumulate(map(tokens, sentences))]
    chunks: list[str] = []

    def emit(start: int, end: int, accept) -> None:
        chunk = " ".join(sentences[start:end])
        if accept(chunk):
            chunks.append(chunk)

    def big_enough(chunk: str) -> bool:
        size = tokens(chunk)
        return size >= sizes.min_tokens or (
            size >= sizes.valuable_min_tokens and bool(valuable.search(chunk))
        )

    def overlap(start: int, end: int) -> int:
        while position[end] - position[start] > sizes.overlap_tokens:
            start += 1
        return start

    start = 0
    for end in range(1, len(sentences) + 1):
        # ``end`` is one past the sentence that is added now.
        if end - 1 > start and position[end] - position[start] > sizes.max_tokens:
            emit(start, end - 1, big_enough)
            start = overlap(start, end - 1)
        size = position[end] - position[start]
        if (
            end < len(sentences)
            and sizes.min_tokens <= size <= sizes.max_tokens
            and position[end + 1] - position[start] > sizes.max_tokens
        ):
            emit(start, end, bool)
            start = overlap(start, end)
    if start < len(sentences):
        emit(start, len(sentences), lambda chunk: not chunks or big_enough(chunk))
    return chunks


def make_chunks(
    sections: DataFrame,
    sizes: ChunkSizes = ChunkSizes(),
    min_section_chars: int = config.CHUNK_MIN_SECTION_CHARS,
) -> DataFrame:
    """Split sections into overlapping chunks; no shuffle.

    A section within ``max_tokens`` is one chunk and stays in the JVM. Only longer texts
    are sent to the Python fold (the others are NULL there).
    """

    @F.pandas_udf("array<string>")
    def fold_long(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: None if text is None else fold_sentences(text, sizes))

    text = F.col("text")
    total = F.aggregate(
        F.transform(F.split(text, _SENTENCE_GAP), t.chunk_tokens),
        F.lit(0).cast("long"),
        lambda total, tokens: total + tokens,
    )
    # n words never cost more than 2n tokens, so short texts need no sentence split.
    is_long = (F.length(text) > sizes.max_tokens) & (total > sizes.max_tokens)
    whole = t.trim_ws(F.regexp_replace(text, _SENTENCE_GAP, " "))
    return (
        sections.where(F.length(t.trim_ws(text)) >= min_section_chars)
        .withColumn("_long", F.when(is_long, text))
        .withColumn("_chunks", fold_long("_long"))
        .select(
            "page_ord",
            "section_index",
            "source_url",
            "title",
            F.coalesce("section_title", F.lit("")).alias("section"),
            F.posexplode_outer(F.coalesce("_chunks", F.array(whole))).alias(
                "chunk_index", "content"
            ),
        )
        .where(F.col("content").isNotNull())
        .select(
            F.concat_ws(
                "-",
                _slug(F.regexp_replace("source_url", r"(?s)\A(.*?)https?://", "$1"), 30),
                _slug(F.coalesce(F.nullif("section", F.lit("")), F.lit("untitled")), 20),
                "section_index",
                "chunk_index",
            ).alias("id"),
            "content", "source_url", "title", "section", "chunk_index", "page_ord",
            "section_index",
        )
    )


def _slug(text: Column, length: int) -> Column:
    return F.substring(F.lower(F.regexp_replace(text, "[^a-zA-Z0-9]", "-")), 1, length)


# -- filtering -------------------------------------------------------------------------


def _is_navigation(content: Column, section: Column, rules: ChunkRules) -> Column:
    short = F.length(content) < 50

    def noisy(lowered: Column) -> Column:
        hits = t.count_contained(rules.navigation_keywords, lowered, F.lower(section))
        leads = t.any_of(F.startswith(lowered, F.lit(lead)) for lead in rules.navigation_leads)
        return (short & t.contains_any(lowered, rules.navigation_phrases)) | (
            ~t.has_value(content, rules.valuable_in_navigation)
            & ((hits >= 3) | ((hits >= 2) & short) | (leads & short))
        )

    return t.let(F.lower(content), noisy)


def _is_consent(content: Column, section: Column, title: Column, rules: ChunkRules) -> Column:
    def mentions(text: Column) -> Column:
        return t.let(F.lower(text), lambda low: t.contains_any(low, rules.consent_keywords))

    informative = t.has_value(content, rules.valuable_in_consent) & (F.length(content) > 100)
    return (mentions(section) | mentions(title) | mentions(content)) & ~informative


def _is_fragmented(content: Column, rules: ChunkRules) -> Column:
    def fragments(text: Column) -> Column:
        pieces = F.filter(
            F.transform(F.split(text, r"[.!?]+"), t.trim_ws), lambda piece: piece != ""
        )
        one_short_sentence = (
            (F.length(text) < 50)
            & F.endswith(text, F.lit("."))
            & (F.regexp_count(text, F.lit(r"\.")) == 1)
        )
        only_short_sentences = t.let(
            pieces,
            lambda pieces: (F.size(pieces) > 5)
            & F.forall(pieces, lambda piece: F.length(piece) < 20),
        )
        return (
            one_short_sentence
            | t.any_of(F.endswith(text, F.lit(end)) for end in rules.fragment_endings)
            | t.contains_any(text, ("[]", "[ ]"))
            | only_short_sentences
        )

    return t.let(t.trim_ws(content), fragments)


def _is_low_quality(content: Column) -> Column:
    text = t.trim_ws(content)
    return ~(
        (F.length(text) > 50) | text.rlike(r"(?iu)[a-zæøå]{4,}") | text.rlike("[0-9]")
    )


def duplicate_key(content: Column) -> Column:
    """Digest of the text without case, punctuation and spacing differences."""
    text = t.collapse_ws(t.trim_ws(F.lower(content)))
    return F.unhex(F.sha2(F.regexp_replace(text, r"[.,!?;:]", ""), 256))


def classify_chunks(chunks: DataFrame, rules: ChunkRules = ChunkRules()) -> DataFrame:
    """Add ``reason``: the first rule that rejects a chunk, NULL if none does.

    Duplicates are found afterwards, by ``dedup_chunks`` or ``keep_first_chunks``.
    """
    content = F.col("content")
    section = F.coalesce("section", F.lit(""))
    title = F.coalesce("title", F.lit(""))
    return chunks.withColumn(
        "reason",
        F.when(_is_navigation(content, section, rules), NAVIGATION)
        .when(_is_consent(content, section, title, rules), CONSENT)
        .when(t.word_count(content) < rules.min_words, TOO_SHORT)
        .when(_is_fragmented(content, rules), FRAGMENTED)
        .when(_is_low_quality(content), LOW_QUALITY),
    )


def dedup_chunks(classified: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Set ``reason`` to ``duplicate`` where an earlier kept chunk has the same text.

    Only kept chunks make later ones duplicates, and being a duplicate is tested before
    low quality. Chunks are stored once with their digest and position in the shared folder
    (a job runs here), so rules and digests are evaluated once. The first kept position per
    text is a hash aggregate over those two narrow columns, combined before the shuffle, and
    is looked up by the rows afterwards; texts with more than ``hot_rows`` copies by
    broadcast. Rejected rows get a key of their own.
    """
    own_key = F.unhex(F.sha2(F.concat_ws("/", *_ORDER), 256))
    passed = F.coalesce("reason", F.lit(LOW_QUALITY)) == LOW_QUALITY
    keyed = stored(
        classified.withColumns(
            {
                "_passed": passed,
                "_text": F.when(passed, duplicate_key(F.col("content"))).otherwise(own_key),
                "_place": _place(),
            }
        )
    )
    texts = (
        keyed.where("_passed")
        .groupBy("_text")
        .agg(
            F.min(F.when(F.col("reason").isNull(), F.col("_place"))).alias("_first"),
            F.count(F.lit(1)).alias("_n"),
        )
    )
    firsts = texts.select("_text", "_first")
    hot = texts.where(F.col("_n") > hot_rows).select("_text", "_first")
    return (
        lookup(keyed, firsts, "_text", hot, own_key)
        .withColumn(
            "reason",
            F.when(F.col("_passed") & (F.col("_first") < F.col("_place")), DUPLICATE).otherwise(
                F.col("reason")
            ),
        )
        .select(*classified.columns)
    )


def _place() -> Column:
    """The position of a chunk as one number of fixed width, for hash aggregates."""
    page, section, chunk = (F.col(name).cast("decimal(38,0)") for name in _ORDER)
    block = F.lit(2**31).cast("decimal(10,0)")  # 63 + 31 + 31 bits fit 38 digits
    return ((page * block + section) * block + chunk).cast("decimal(38,0)")


def keep_first_chunks(classified: DataFrame) -> DataFrame:
    """The kept chunks only: the first of each text among those no rule rejects.

    Kept chunks are stored once with their digest and position (a job runs here). The first row
    per text is a hash aggregate over narrow columns, combined before its shuffle; texts are
    neither sorted nor aggregated, and only fetched for the rows that stay.
    """
    kept = stored(
        classified.where(F.col("reason").isNull())
        .drop("reason")
        .withColumns(
            {
                "_text": duplicate_key(F.col("content")),
                "_place": _place(),
                "_row": F.monotonically_increasing_id(),
            }
        )
    )
    firsts = kept.groupBy("_text").agg(F.min_by("_row", "_place").alias("_row"))
    return kept.join(firsts.select("_row"), "_row", "left_semi").drop("_text", "_place", "_row")


def cleaning_report(pages: DataFrame, cleaned: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row of before/after counts; ``chunks`` carry the final ``reason``.

    Low-quality chunks count as fragmented. The percentage is NULL without chunks.
    """
    reason = F.col("reason")
    counts = [
        pages.agg(
            F.count(F.lit(1)).alias("pages_before"),
            F.sum(F.size("sections")).cast("long").alias("sections_before"),
        ),
        cleaned.agg(
            F.count_if(F.col("section_index") == 0).alias("pages_after"),
            F.count(F.lit(1)).alias("sections_after"),
        ),
        chunks.agg(
            F.count(F.lit(1)).alias("chunks_created"),
            F.count_if(reason.isNull()).alias("chunks_kept"),
            F.count_if(reason == NAVIGATION).alias("navigation"),
            F.count_if(reason == CONSENT).alias("consent"),
            F.count_if(reason == TOO_SHORT).alias("too_short"),
            F.count_if(reason == DUPLICATE).alias("duplicates"),
            F.count_if(reason.isin(FRAGMENTED, LOW_QUALITY)).alias("fragmented"),
        ),
    ]
    rows = counts[0]
    for part in counts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    merged = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in rows.columns])
    removed = F.col("chunks_created") - F.col("chunks_kept")
    return merged.withColumns(
        {
            "chunks_removed": removed,
            "removed_pct": F.round(
                F.try_divide(removed * F.lit(100.0), F.col("chunks_created")), 1
            ),
        }
    )
