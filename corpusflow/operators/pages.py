"""Page ingestion: what to crawl, sections of crawled pages, and the page table.

Raw pages are ``(page_ord, url, source_url, markdown, metadata)``, ingested pages
``(page_ord, source_url, title, sections)`` with sections ``(section_title, text)``.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterable

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow import config
from corpusflow.functions import text as t
from corpusflow.functions.lineage import lookup
from corpusflow.operators.urls import is_system_url


# -- crawl planning --------------------------------------------------------------------


def plan_crawl(
    urls: DataFrame,
    pages: DataFrame,
    start_url: str,
    force: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """The ``urls(ord, url)`` that are not in ``pages`` yet, the first ``limit`` if given.

    The usual limit of one run is ``config.CRAWL_LIMIT``. URLs are compared without a trailing slash; ``force`` takes them all. With nothing
    left to crawl the result is the start URL.
    """
    todo = urls.select("ord", "url")
    if not force:
        known = (
            pages.select(t.drop_trailing_slash(F.col("source_url")).alias("_key"))
            .distinct()
            .withColumn("_known", F.lit(True))
        )
        keyed = todo.withColumn("_key", t.drop_trailing_slash(F.col("url")))
        todo = lookup(keyed, known, "_key").where(F.col("_known").isNull())
    planned = todo.select("ord", "url")
    if limit is not None:
        planned = planned.orderBy("ord").limit(limit)
    fallback = urls.sparkSession.range(1).select(
        F.lit(None).cast("bigint").alias("ord"), F.lit(start_url).alias("url"), F.lit(1).alias("_any")
    )
    any_planned = planned.select(F.lit(1).alias("_any")).limit(1)
    return planned.union(fallback.join(any_planned, "_any", "left_anti").select("ord", "url"))


def tag_special_pages(urls: DataFrame, patterns: Iterable[str]) -> DataFrame:
    """Add ``needs_load_more``: the lower-cased URL without trailing slash matches a rule.

    A pattern that is no valid regular expression is skipped with a warning.
    """
    usable = []
    for pattern in patterns:
        try:
            urls.sparkSession._jvm.java.util.regex.Pattern.compile(pattern)
            usable.append(pattern)
        except IllegalArgumentException:
            warnings.warn(f"invalid URL pattern skipped: {pattern}", stacklevel=2)
    url = t.drop_trailing_slash(F.lower("url"))
    return urls.withColumn("needs_load_more", t.any_of(url.rlike(p) for p in usable))


def best_attempt(attempts: DataFrame) -> DataFrame:
    """Per URL the attempt with the longest markdown, the earliest on ties.

    ``attempts(url, attempt, markdown)``; URLs whose attempts are all empty disappear.
    """
    return (
        attempts.where(F.length("markdown") > 0)
        .groupBy("url")
        .agg(
            F.max_by(
                F.struct("attempt", "markdown"), F.struct(F.length("markdown"), -F.col("attempt"))
            ).alias("best")
        )
        .select("url", "best.attempt", "best.markdown")
    )


# -- HTML and sections -----------------------------------------------------------------

# Entities decoded in page text; the ampersand comes last.
_PAGE_ENTITIES = (
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
    ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
)
_BLOCK_TAGS = (
    "address|article|aside|blockquote|body|dd|div|dl|dt|figure|footer|form|header|html|"
    "main|nav|ol|p|pre|section|table|td|th|tr|ul"
)


def pages_to_markdown(pages: DataFrame) -> DataFrame:
    """Raw pages from ``pages(page_id, url, html)``.

    Scripts, styles, comments and the head are dropped, headings and list items become
    markdown, block tags end lines, entities are decoded.
    """
    html = F.col("html")
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    dropped = [
        (rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
        for tag in ("script", "style", "noscript", "head")
    ]
    headings = [
        (rf"(?is)<h{n}\b[^>]*>(.*?)</h{n}\s*>", "\n\n" + "#" * n + " $1\n\n")
        for n in range(1, 7)
    ]
    markdown = t.replace_all(
        html,
        *dropped,
        (r"(?s)<!--.*?-->", ""),
        *headings,
        (r"(?i)<li\b[^>]*>", "\n- "),
        (rf"(?i)</?(?:{_BLOCK_TAGS}|br|li)\b[^>]*>", "\n"),
        (r"<[^>]+>", ""),
    )
    markdown = t.replace_all(
        t.decode_entities(markdown, _PAGE_ENTITIES),
        (r"(?m)[ \t]+$", ""),
        (r"\n{3,}", "\n\n"),
    )
    return pages.select(
        F.col("page_id").alias("page_ord"),
        "url",
        F.lit(None).cast("string").alias("source_url"),
        t.trim_ws(markdown).alias("markdown"),
        F.struct(
            t.trim_ws(t.decode_entities(title, _PAGE_ENTITIES)).alias("title"),
            F.lit(None).cast("string").alias("source_url"),
        ).alias("metadata"),
    )


def _is_boilerplate_text(text: Column, patterns: Iterable[str]) -> Column:
    trimmed = t.trim_ws(text)
    marks = F.regexp_count(text, F.lit(r"https?://|@|www\."))
    result = (
        (F.length(trimmed) < 10)
        | ((t.word_count(trimmed) <= 2) & (F.length(trimmed) < 30))
        | (marks > F.length(text) / 20)
    )
    joined = _one_of(patterns)
    return result | text.rlike(joined) if joined else result


def _is_boilerplate_title(title: Column, patterns: Iterable[str]) -> Column:
    joined = _one_of(patterns)
    if not joined:
        return F.lit(False)
    return (t.trim_ws(title) != "") & F.lower(title).rlike(joined)


def _one_of(patterns: Iterable[str]) -> str:
    body = "|".join(t.with_unicode_spaces(pattern) for pattern in patterns)
    return f"(?iu)(?:{body})" if body else ""


def extract_sections(
    pages: DataFrame,
    keep_all: bool = True,
    text_patterns: Iterable[str] = config.BOILERPLATE_TEXT,
    title_patterns: Iterable[str] = config.BOILERPLATE_TITLE,
    keep_preamble: bool = False,
) -> DataFrame:
    """Ingested pages from raw pages, split at second- and third-level headings.

    The URL is the first non-empty of ``url``, ``source_url`` and the metadata URL;
    system URLs are dropped. The title is the first top-level heading, else the metadata
    title. A page without headings is one untitled section; with headings the text before
    the first one is dropped unless ``keep_preamble``. Empty sections are dropped, and
    without ``keep_all`` those with a boilerplate title or text as well.
    """
    blank = F.lit("")
    source_url = F.coalesce(
        F.nullif("url", blank), F.nullif("source_url", blank),
        F.nullif("metadata.source_url", blank), blank,
    )
    markdown = F.coalesce("markdown", blank)
    h1 = t.trim_ws(F.regexp_extract(markdown, rf"(?m)^#{t.WS}+(.+)$", 1))
    title = F.coalesce(F.nullif(h1, blank), F.nullif("metadata.title", blank))

    # Mark headings with control characters, then split on them.
    begin, end = "\u0001", "\u0002"
    marked = F.regexp_replace(
        F.regexp_replace(markdown, f"[{begin}{end}]", ""),
        rf"(?m)^#{{2,3}}{t.WS}+(.+)$",
        f"{begin}$1{end}",
    )

    def section(title: Column, body: Column) -> Column:
        return F.struct(
            title.alias("section_title"),
            t.clean_page_text(t.markdown_to_plain(body)).alias("text"),
        )

    def titled(part: Column) -> Column:
        return t.let(
            F.split(part, end), lambda halves: section(t.trim_ws(halves[0]), halves[1])
        )

    def split_up(parts: Column) -> Column:
        untitled = F.array(section(blank, parts[0]))
        rest = F.transform(F.slice(parts, F.lit(2), F.size(parts)), titled)
        if keep_preamble:
            return F.concat(untitled, rest)
        return F.when(F.size(parts) == 1, untitled).otherwise(rest)

    def keep(section: Column) -> Column:
        kept = section["text"] != ""
        if not keep_all:
            kept = (
                kept
                & ~_is_boilerplate_title(section["section_title"], title_patterns)
                & ~_is_boilerplate_text(section["text"], text_patterns)
            )
        return kept

    sections = F.filter(t.let(F.split(marked, begin), split_up), keep)
    return pages.select(
        "page_ord", source_url.alias("source_url"), title.alias("title"),
        sections.alias("sections"),
    ).where(~is_system_url(F.col("source_url"), config.CRAWL_EXCLUSIONS))


# -- the page table --------------------------------------------------------------------


def upsert_pages(existing: DataFrame, new: DataFrame, offset: int | None = None) -> DataFrame:
    """Merge new pages into the page table, one row per URL without trailing slash.

    New beats old and later beats earlier; a replaced page keeps its position, new URLs
    follow the existing ones: their ``page_ord`` is shifted by ``offset``, by default the
    first position after the existing pages.
    """
    columns = ["source_url", "title", "sections"]
    both = existing.select(F.lit(0).alias("gen"), "page_ord", *columns).unionByName(
        new.select(F.lit(1).alias("gen"), "page_ord", *columns)
    )
    merged = both.groupBy(t.drop_trailing_slash(F.col("source_url")).alias("url_key")).agg(
        F.min(F.struct("gen", "page_ord")).alias("position"),
        F.max_by(F.struct(*columns), F.struct("gen", "page_ord")).alias("page"),
    )
    if offset is None:
        offset = existing.agg((F.max("page_ord") + 1).alias("n")).first().n or 0
    return merged.select(
        "url_key",
        F.when(F.col("position.gen") == 0, F.col("position.page_ord"))
        .otherwise(F.col("position.page_ord") + F.lit(offset))
        .alias("page_ord"),
        "page.*",
    )


def page_stats(pages: DataFrame) -> DataFrame:
    """One row: pages, sections, characters of section text."""
    chars = F.aggregate(
        "sections", F.lit(0).cast("long"), lambda total, s: total + F.length(s["text"])
    )
    return pages.agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum(F.size("sections")).cast("long").alias("sections"),
        F.sum(chars).alias("text_chars"),
    )


def crawl_outcome(fetch_log: DataFrame) -> DataFrame:
    """Number of fetches per status of ``fetch_log(url, status)``."""
    return fetch_log.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
