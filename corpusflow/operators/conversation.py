"""Conversation windows over ``turns(conv_id, turn, role, text)``.

``turn`` is a non-negative integer, unique within a conversation. Every user turn is a
query; its history is the earlier user and assistant turns. Conversations are cut into
blocks (by turn, or by token position), so a very long one is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow import config
from corpusflow.functions import text as t
from corpusflow.functions.lineage import in_sequence

HISTORY_BLOCK = 256


def history_turns(turns: DataFrame, welcome_marker: str = config.WELCOME_MARKER) -> DataFrame:
    """Turns that count as history: no errors, no system turns, no welcome message."""
    text = F.coalesce("text", F.lit(""))
    welcome = (F.col("role") == "assistant") & F.contains(text, F.lit(welcome_marker))
    return turns.where(F.col("role").isin("user", "assistant") & ~welcome).select(
        "conv_id", "turn", "role", text.alias("text")
    )


def _numbered(turns: DataFrame, welcome_marker: str) -> DataFrame:
    return in_sequence(
        history_turns(turns, welcome_marker), ["conv_id"], "turn",
        t.chat_tokens(F.col("text")), ("role",),
    )


def _earlier(queries: DataFrame, numbered: DataFrame, block: int) -> DataFrame:
    """Rows ``(conv_id, turn, part, earlier)``: the history of each query in pieces.

    A piece is an array of at most ``block`` turns, so the rows carried per query are its
    history length divided by ``block``.
    """
    pieces = numbered.groupBy("conv_id", F.floor(F.col("seq") / block).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("seq", "turn", "role", "text"))).alias("rows")
    )
    wanted = queries.select(
        "conv_id", "turn", "seq",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("seq") / block))).alias("part"),
    )
    return wanted.join(pieces, ["conv_id", "part"]).select(
        "conv_id", wanted["turn"], "part",
        F.filter("rows", lambda row: row["seq"] < F.col("seq")).alias("earlier"),
    )


def conversation_history(
    turns: DataFrame, welcome_marker: str = config.WELCOME_MARKER
) -> DataFrame:
    """``(conv_id, turn, question, history)`` per user turn, history oldest first.

    Each row holds the whole history by definition, so the output grows with the square
    of a conversation's length. ``trim_history`` and ``contextual_queries`` work from the
    turns and do not go through it.
    """
    numbered = _numbered(turns, welcome_marker)
    queries = numbered.where("role = 'user'")
    histories = (
        _earlier(queries, numbered, HISTORY_BLOCK)
        .groupBy("conv_id", "turn")
        .agg(F.array_sort(F.collect_list(F.struct("part", "earlier"))).alias("parts"))
        .select(
            "conv_id",
            "turn",
            F.transform(
                F.flatten(F.col("parts.earlier")),
                lambda row: F.struct(
                    row["turn"].alias("turn"), row["role"].alias("role"),
                    row["text"].alias("text"),
                ),
            ).alias("history"),
        )
    )
    return queries.select("conv_id", "turn", F.col("text").alias("question")).join(
        histories, ["conv_id", "turn"]
    )


def contextual_queries(
    turns: DataFrame,
    max_words: int = config.FOLLOW_UP_MAX_WORDS,
    assistant_chars: int = config.FOLLOW_UP_ASSISTANT_CHARS,
    user_chars: int = config.FOLLOW_UP_USER_CHARS,
    welcome_marker: str = config.WELCOME_MARKER,
) -> DataFrame:
    """``(conv_id, turn, question, search_text)`` per user turn.

    A question of at most ``max_words`` words is followed by the earlier turns (assistant
    turns under ``assistant_chars`` characters, user turns under ``user_chars``), oldest
    first. Only such questions fetch their history.
    """
    numbered = _numbered(turns, welcome_marker)
    queries = numbered.where("role = 'user'")
    follow_ups = queries.where((t.word_count(F.col("text")) <= max_words) & (F.col("seq") > 0))

    def short_enough(row: Column) -> Column:
        limit = F.when(row["role"] == "assistant", assistant_chars).otherwise(user_chars)
        return F.length(row["text"]) < limit

    context = (
        _earlier(follow_ups, numbered, HISTORY_BLOCK)
        .withColumn("kept", F.filter("earlier", short_enough))
        .where(F.size("kept") > 0)
        .select(
            "conv_id", "turn", "part",
            F.array_join(F.transform("kept", lambda row: row["text"]), " ").alias("piece"),
        )
        .groupBy("conv_id", "turn")
        .agg(F.array_sort(F.collect_list(F.struct("part", "piece"))).alias("pieces"))
        .select("conv_id", "turn", F.array_join(F.col("pieces.piece"), " ").alias("context"))
    )
    question = F.col("question")
    return (
        queries.select("conv_id", "turn", F.col("text").alias("question"))
        .join(context, ["conv_id", "turn"], "left")
        .select(
            "conv_id", "turn", "question",
            F.when(F.col("context").isNull(), question)
            .otherwise(F.concat(question, F.lit(" "), F.col("context")))
            .alias("search_text"),
        )
    )


def trim_history(
    turns: DataFrame,
    budget: int = config.HISTORY_BUDGET,
    reference_order: bool = False,
    welcome_marker: str = config.WELCOME_MARKER,
) -> DataFrame:
    """The newest history that fits in ``budget`` tokens, per user turn.

    Returns ``(conv_id, turn, question, history, history_tokens)``. An assistant turn
    directly after a user turn is charged together with it. The first unit that does not
    fit is cut when less than 90 % of the budget is used and at least 50 tokens remain: a
    single turn is cut, of a pair the user turn is kept and the assistant turn cut, or
    only the user turn is kept (cut) when fewer than 50 tokens would be left after it.

    History is chronological; ``reference_order`` puts the assistant turn of each pair
    before its user turn.

    Which turns form a unit does not depend on the query, so with token positions along
    the conversation the kept history is everything within ``budget`` of the query, and
    the unit across that edge is the one to cut. Queries and units meet in buckets of
    ``budget`` tokens: a unit can only be wanted by the bucket it ends in and the next, so
    a bucket gathers two budgets' worth of text however long the conversation is.
    """
    start, own = F.col("start"), F.col("_tokens")
    answers = (F.col("role") == "assistant") & (F.col("prev.role") == "user")
    answered = (F.col("role") == "user") & (F.col("next.role") == "assistant")
    numbered = _numbered(turns, welcome_marker).withColumns(
        {
            "unit_start": F.when(answers, start - F.col("prev._tokens")).otherwise(start),
            "unit_end": start + own + F.when(answered, F.col("next._tokens")).otherwise(0),
            "user_tokens": F.when(answers, F.col("prev._tokens")).when(answered, own),
            "unit_order": F.when(answers, F.col("seq") * 2 - 3).otherwise(F.col("seq") * 2),
        }
    )
    unit = F.struct(
        *(["unit_order"] if reference_order else []),
        "seq", "turn", "role",
        F.substring("text", 1, budget * config.CHARS_PER_TOKEN + 1).alias("text"),
        "unit_start", "unit_end", "user_tokens",
    )
    query = F.struct("turn", F.col("text").alias("question"), "seq", "start")

    def place(position: Column, is_query: bool) -> Column:
        return F.struct(
            F.floor(position / budget).alias("bucket"), F.lit(is_query).alias("is_query")
        )

    as_unit = [place(F.col("unit_end") + shift, False) for shift in (0, budget)]
    places = F.when(
        F.col("role") == "user", F.array(*as_unit, place(start, True))
    ).otherwise(F.array(*as_unit))
    is_query = F.col("place.is_query")
    buckets = (
        numbered.withColumn("place", F.explode(places))
        .groupBy("conv_id", F.col("place.bucket").alias("bucket"))
        .agg(
            F.array_sort(F.collect_list(F.when(~is_query, unit))).alias("units"),
            F.collect_list(F.when(is_query, query)).alias("queries"),
        )
        .select("conv_id", "units", F.explode("queries").alias("query"))
        .select("conv_id", "units", "query.*")
    )
    edge = F.col("start") - F.lit(budget)

    def kept(unit: Column) -> Column:
        whole = unit["unit_start"] >= edge
        left = unit["unit_end"] - edge
        used = F.lit(budget) - left
        user_tokens = unit["user_tokens"]
        both = left >= user_tokens + config.PARTIAL_MIN_TOKENS
        is_user = unit["role"] == "user"
        text = unit["text"]
        cut = (
            F.when(user_tokens.isNull(), t.truncate_to_tokens(text, left))
            .when(is_user & both, text)
            .when(is_user, t.truncate_to_tokens(text, left))
            .when(both, t.truncate_to_tokens(text, left - user_tokens))
        )
        may_cut = (
            (unit["unit_end"] >= edge)
            & (used < budget * config.HISTORY_NEARLY_FULL)
            & (left >= config.PARTIAL_MIN_TOKENS)
        )
        return F.struct(
            unit["turn"].alias("turn"),
            unit["role"].alias("role"),
            F.when(whole, text).when(may_cut, cut).alias("text"),
        )

    before = F.filter("units", lambda unit: unit["seq"] < F.col("seq"))
    history = F.filter(F.transform(before, kept), lambda row: row["text"].isNotNull())
    return (
        buckets.select("conv_id", "turn", "question", history.alias("history"))
        .withColumn(
            "history_tokens",
            F.aggregate(
                "history",
                F.lit(0).cast("long"),
                lambda total, row: total + t.chat_tokens(row["text"]),
            ),
        )
    )


def sanitize_messages(turns: DataFrame) -> DataFrame:
    """Add ``clean_text``: URLs, citations, links, source notes and tags removed, e-mail
    addresses wrapped as mail links."""
    clean = t.replace_all(
        F.col("text"),
        (f"{config.URL_START_PATTERN}{t.NON_WS}+", ""),
        (t.with_unicode_spaces(config.CITATION_PATTERN), ""),
        (config.MARKDOWN_LINK_PATTERN, "$1"),
        (config.BASED_ON_PATTERN, ""),
        (config.TAG_PATTERN, ""),
        (config.MAIL_PATTERN, config.MAIL_LINK),
    )
    return turns.withColumn("clean_text", clean)
