"""Column rules for text, shared by all operators.

Whitespace, trimming and case folding follow the browser-side definitions the corpus was
built with: Unicode spaces and U+FEFF count as whitespace, case-insensitive matching
folds letters such as ``Å``. Lengths are code points.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow import config

# Fixed value: the whitespace characters, as a regex class body and as plain characters.
WS_CHARS = r"\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACES = (
    "\t\n\x0b\f\r \u00a0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
WS = f"[{WS_CHARS}]"
NON_WS = f"[^{WS_CHARS}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def replace_all(text: Column, *rules: tuple[str, str]) -> Column:
    """Apply regex replacements in order."""
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def replace_if_found(text: Column, needle: str, *rules: tuple[str, str]) -> Column:
    """Regex replacements that can only match where ``needle`` occurs.

    Looking for a substring is far cheaper than a regex pass, and most texts have no
    markup of a given kind.
    """
    return let(
        text,
        lambda text: F.when(F.contains(text, F.lit(needle)), replace_all(text, *rules)).otherwise(
            text
        ),
    )


def with_unicode_spaces(pattern: str) -> str:
    r"""``pattern`` with ``\s`` read as the shared whitespace class."""
    return pattern.replace(r"\s", WS)


def literal(text: str) -> str:
    """``text`` as a Java regex that matches it exactly."""
    return re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", text)


def trim_ws(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def collapse_ws(text: Column) -> Column:
    """Every run of whitespace becomes one space."""
    return F.regexp_replace(F.translate(text, SPACES, " " * len(SPACES)), "  +", " ")


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words; 0 for NULL."""

    def words(line: Column) -> Column:
        gaps = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))
        return F.when((line == "") | line.isNull(), 0).otherwise(gaps + 1)

    return let(F.trim(collapse_ws(text)), words)


def drop_trailing_slash(url: Column) -> Column:
    """Remove one trailing slash."""
    return F.regexp_replace(url, r"/\z", "")


def any_of(conditions: Iterable[Column]) -> Column:
    result = F.lit(False)
    for condition in conditions:
        result = result | condition
    return result


def contains_any(text: Column, needles: Iterable[str]) -> Column:
    return any_of(F.contains(text, F.lit(needle)) for needle in needles)


def count_contained(needles: Iterable[str], *texts: Column) -> Column:
    """How many of ``needles`` occur in at least one of ``texts``."""
    total = F.lit(0)
    for needle in needles:
        found = any_of(F.contains(text, F.lit(needle)) for text in texts)
        total = total + found.cast("int")
    return total


def words_pattern(words: Iterable[str]) -> str:
    """Case-insensitive regex that finds any of ``words``."""
    return "(?iu)" + "|".join(literal(word) for word in words)


def has_value(text: Column, words: Iterable[str]) -> Column:
    """True when the text holds a digit or one of ``words``."""
    return text.rlike(r"[0-9]") | text.rlike(words_pattern(words))


def chunk_tokens(text: Column) -> Column:
    """Word-based token estimate used by chunking."""
    return F.ceil(word_count(text) * F.lit(config.CHUNK_TOKENS_PER_WORD))


def chat_tokens(text: Column) -> Column:
    """Character-based token estimate used by prompts."""
    return F.ceil(F.length(text) * F.lit(config.TOKENS_PER_CHAR))


def _last_index(text: Column, char: str) -> Column:
    """0-based index of the last ``char``, -1 when absent."""
    located = F.locate(char, F.reverse(text))
    return F.when(located > 0, F.length(text) - located).otherwise(F.lit(-1))


def truncate_to_tokens(text: Column, tokens: Column) -> Column:
    """Cut to ``tokens``: after a late sentence end, else at a late space, else hard."""
    limit = (tokens * config.CHARS_PER_TOKEN).cast("int")

    def cut(head: Column) -> Column:
        sentence_end = F.greatest(*[_last_index(head, mark) for mark in ".!?"])
        space = _last_index(head, " ")
        return (
            F.when(sentence_end > limit * F.lit(0.7), F.substring(head, 1, sentence_end + 1))
            .when(
                space > limit * F.lit(0.8),
                F.concat(F.substring(head, 1, space), F.lit("...")),
            )
            .otherwise(F.concat(head, F.lit("...")))
        )

    return F.when(F.length(text) <= limit, text).otherwise(
        let(F.substring(text, F.lit(1), limit), cut)
    )


# --------------------------------------------------------------------------------------
# Markup removal
# --------------------------------------------------------------------------------------

# Markup patterns.
_LINK = (r"\[([^\]]+)\]\([^)]+\)", "$1")
_IMAGE = (r"!\[([^\]]*)\]\([^)]+\)", "")
_FENCE = (r"(?s)```.*?```", "")
_INLINE_CODE = (r"`[^`]+`", "")
_BOLD = (r"\*\*([^*]+)\*\*", "$1")
_ITALIC = (r"\*([^*]+)\*", "$1")
_BOLD_UNDERSCORE = (r"__([^_]+)__", "$1")
_ITALIC_UNDERSCORE = (r"_([^_]+)_", "$1")
_HEADING_MARKS = (rf"(?m)^#{{1,6}}{WS}+", "")
_QUOTE_MARKS = (rf"(?m)^>{WS}+", "")
_DASH_RULE = (r"(?m)^---$", "")
_STAR_RULE = (r"(?m)^\*\*\*$", "")


def _drop_emphasis(text: Column) -> Column:
    text = replace_if_found(text, "*", _BOLD, _ITALIC)
    return replace_if_found(text, "_", _BOLD_UNDERSCORE, _ITALIC_UNDERSCORE)


def _drop_rules_and_quotes(text: Column) -> Column:
    text = replace_if_found(text, "---", _DASH_RULE)
    text = replace_if_found(text, "***", _STAR_RULE)
    return replace_if_found(text, ">", _QUOTE_MARKS)


# Entities decoded by chunk cleaning, in decoding order.
ENTITIES = (
    ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"),
    ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
)


def decode_entities(text: Column, entities: Iterable[tuple[str, str]] = ENTITIES) -> Column:

    def decode(text: Column) -> Column:
        for entity, char in entities:
            text = F.replace(text, F.lit(entity), F.lit(char))
        return text

    return let(
        text, lambda text: F.when(F.contains(text, F.lit("&")), decode(text)).otherwise(text)
    )


def clean_section_text(text: Column) -> Column:
    """Chunk-side cleaning: tags, entities, markdown, bullets, whitespace, punctuation."""
    text = decode_entities(replace_if_found(text, "<", (r"<[^>]+>", "")))
    text = replace_if_found(
        text,
        "[",
        _LINK,
        (r"\\\[([^\]]+)\\\]\([^)]+\)", "$1"),
        _IMAGE,
        (r"!\\\[([^\]]*)\\\]\([^)]+\)", ""),
    )
    text = replace_if_found(text, "(http", (rf"\(https?://[^{WS_CHARS})]+\)", ""))
    text = replace_if_found(text, "[", (r"\[([^\]]+)\](?!\()", "$1"))
    text = _drop_emphasis(replace_if_found(text, "#", _HEADING_MARKS))
    text = replace_if_found(text, "`", _INLINE_CODE, _FENCE)
    text = replace_if_found(text, ">", _QUOTE_MARKS)
    text = replace_all(
        text,
        (r"(?m)^[-*]{3,}$", ""),
        (rf"(?m)^[-*+]{WS}+", ""),
        (rf"(?m)^[0-9]+\.{WS}+", ""),
    )
    text = replace_if_found(text, "\\[", (r"\\\[\.+\\\]", ""))
    text = trim_ws(collapse_ws(text))
    # Pull detached punctuation back to the word before it.
    return F.regexp_replace(
        text, r" +(?=[.!?] )|(?<=[.!?]) +(?=[.!?]+(?: |\z))", ""
    )


def markdown_to_plain(markdown: Column) -> Column:
    """Markdown to prose; list items become sentences at the end, bullets first."""
    bullet = rf"(?m)^[-*+]{WS}+(.+)$"
    number = rf"(?m)^[0-9]+\.{WS}+(.+)$"

    def as_sentences(items: Column) -> Column:
        trimmed = F.filter(F.transform(items, trim_ws), lambda item: item != "")
        return F.transform(
            trimmed,
            lambda item: F.when(item.rlike(r"[.!?]\z"), item).otherwise(
                F.concat(item, F.lit("."))
            ),
        )

    def with_lists(text: Column) -> Column:
        rest = F.regexp_replace(text, bullet, "")
        return let(
            rest,
            lambda rest: let(
                F.concat(
                    F.regexp_extract_all(text, F.lit(bullet), F.lit(1)),
                    F.regexp_extract_all(rest, F.lit(number), F.lit(1)),
                ),
                lambda items: F.when(
                    F.size(items) > 0,
                    trim_ws(
                        F.concat(
                            trim_ws(F.regexp_replace(rest, number, "")),
                            F.lit(" "),
                            F.array_join(as_sentences(items), " "),
                        )
                    ),
                ).otherwise(rest),
            ),
        )

    text = replace_if_found(markdown, "`", _FENCE, _INLINE_CODE)
    text = replace_if_found(text, "[", _IMAGE, _LINK)
    text = let(replace_if_found(text, "#", _HEADING_MARKS), with_lists)
    text = trim_ws(collapse_ws(_drop_rules_and_quotes(_drop_emphasis(text))))
    return let(
        text,
        lambda plain: F.when((plain == "") | plain.rlike(r"[.!?]\z"), plain).otherwise(
            F.concat(plain, F.lit("."))
        ),
    )


def clean_page_text(text: Column) -> Column:
    """Crawl-side cleaning: drop URLs and what markup is left."""
    text = replace_if_found(text, "http", (rf"https?://[^{WS_CHARS})]+", ""))
    text = replace_if_found(text, "www.", (rf"www\.{NON_WS}+", ""))
    text = replace_if_found(text, "[", _LINK, _IMAGE)
    text = _drop_emphasis(replace_if_found(text, "`", _FENCE, _INLINE_CODE))
    text = replace_if_found(text, "#", _HEADING_MARKS)
    return trim_ws(collapse_ws(_drop_rules_and_quotes(text)))
