"""Token-budgeted context, prompts and retrieval metrics.

Matches are top-k rows, so the windows here run over at most ``match_count`` rows per
query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow import config
from corpusflow.functions import text as t


def _tokens_of(text: str) -> int:
    return -(-len(text) // config.CHARS_PER_TOKEN)


def _reserved(queries: DataFrame, system_prompt: str) -> Column:
    fixed = _tokens_of(system_prompt) + _tokens_of(config.RESERVED_TEXT)
    history = F.col("history_tokens") if "history_tokens" in queries.columns else F.lit(0)
    return t.chat_tokens(F.col("question")) + F.coalesce(history, F.lit(0)) + F.lit(fixed)


def select_matches(
    matches: DataFrame,
    queries: DataFrame,
    system_prompt: str = "",
    budget: int = config.CONTEXT_BUDGET,
) -> DataFrame:
    """The matches that fit in the budget, in rank order, the last one possibly cut.

    ``queries(query_id, question[, history_tokens])``. The system prompt, the question,
    the fixed prompt text and the history are reserved first; 95 % of the rest is filled.
    A row that does not fit is cut if at least 50 tokens are left, and ends the list.
    """
    safe = F.floor((F.lit(budget) - F.col("_reserved")) * F.lit(config.CONTEXT_SAFETY))
    in_rank = Window.partitionBy("query_id").orderBy("rank")
    tokens = t.chat_tokens(F.col("content"))
    used = F.coalesce(
        F.sum("_tokens").over(in_rank.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    left = F.col("_safe") - F.col("_used")
    fits = F.col("_tokens") <= left
    starts_inside = F.col("_used") <= F.col("_safe")
    cut = ~fits & starts_inside & (left >= config.PARTIAL_MIN_TOKENS)
    return (
        matches.join(
            queries.select("query_id", _reserved(queries, system_prompt).alias("_reserved")),
            "query_id",
        )
        .withColumns({"_tokens": tokens, "_safe": safe})
        .withColumn("_used", used)
        .where((fits & starts_inside) | cut)
        .withColumns(
            {
                "truncated": cut,
                "content": F.when(cut, t.truncate_to_tokens(F.col("content"), left)).otherwise(
                    F.col("content")
                ),
            }
        )
        .drop("_reserved", "_tokens", "_safe", "_used")
    )


def build_contexts(
    selected: DataFrame, queries: DataFrame, system_prompt: str = ""
) -> DataFrame:
    """Per query: the numbered context, how many matches it holds, and its token total.

    Queries whose matches were all squeezed out (or that had none) get an empty context.
    """
    contexts = selected.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "content"))).alias("_rows")
    )
    numbered = F.array_join(
        F.transform(
            F.col("_rows"),
            lambda row, i: F.concat(
                F.lit("["), (i + 1).cast("string"), F.lit("] "), row["content"]
            ),
        ),
        "\n\n",
    )
    return (
        queries.join(contexts, "query_id", "left")
        .withColumns(
            {
                "context": F.coalesce(numbered, F.lit("")),
                "n_selected": F.coalesce(F.size("_rows"), F.lit(0)),
            }
        )
        .select(
            "query_id",
            "context",
            F.greatest("n_selected", F.lit(0)).alias("n_selected"),
            (_reserved(queries, system_prompt) + t.chat_tokens(F.col("context"))).alias(
                "total_tokens"
            ),
        )
    )


def pack_context(
    matches: DataFrame,
    queries: DataFrame,
    system_prompt: str = "",
    budget: int = config.CONTEXT_BUDGET,
) -> DataFrame:
    """``select_matches`` followed by ``build_contexts``."""
    selected = select_matches(matches, queries, system_prompt, budget)
    return build_contexts(selected, queries, system_prompt)


def assemble_prompts(
    contexts: DataFrame,
    queries: DataFrame,
    system_prompt: str,
    histories: DataFrame | None = None,
) -> DataFrame:
    """``(query_id, messages)``: system message, trimmed history, context and question.

    ``histories(query_id, history)`` holds arrays of structs with ``role`` and ``text``.
    """

    def message(role: Column, content: Column) -> Column:
        return F.struct(role.alias("role"), content.alias("content"))

    prompts = queries.select("query_id", "question").join(
        contexts.select("query_id", "context"), "query_id"
    )
    system = F.array(message(F.lit("system"), F.lit(system_prompt)))
    final = F.array(
        message(
            F.lit("user"),
            F.concat(
                F.lit(config.CONTEXT_PREFIX),
                F.col("context"),
                F.lit(config.QUESTION_PREFIX),
                F.col("question"),
            ),
        )
    )
    parts = [system, final]
    if histories is not None:
        prompts = prompts.join(histories.select("query_id", "history"), "query_id", "left")
        turns = F.transform("history", lambda turn: message(turn["role"], turn["text"]))
        parts.insert(1, F.coalesce(turns, F.slice(system, 1, 0)))
    return prompts.select("query_id", F.concat(*parts).alias("messages"))


def retrieval_metrics(
    matches: DataFrame,
    contexts: DataFrame,
    budget: int = config.CONTEXT_BUDGET,
) -> DataFrame:
    """Per query of ``contexts``: matches, best similarity, selection and token use."""
    found = matches.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_matches"), F.max("similarity").alias("top_similarity")
    )
    return contexts.join(found, "query_id", "left").select(
        "query_id",
        F.coalesce("n_matches", F.lit(0)).alias("n_matches"),
        "top_similarity",
        "n_selected",
        "total_tokens",
        F.lit(budget).alias("budget"),
        (F.col("total_tokens") > budget).alias("over_budget"),
        (F.col("n_selected") == 0).alias("empty_context"),
    )


def generate_answers(
    prompts: DataFrame,
    generator: Callable[[list[dict]], str],
    error_answer: str = config.GENERATION_ERROR_ANSWER,
) -> DataFrame:
    """``(query_id, answer)`` from a user's generator, called once per prompt.

    A call that fails gives the fixed error answer; the other prompts go on.
    """

    def answer(messages: list) -> str:
        try:
            return generator([dict(role=m["role"], content=m["content"]) for m in messages])
        except Exception:  # noqa: BLE001 - any failure of the user's model
            return error_answer

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(
                {"query_id": batch["query_id"], "answer": batch["messages"].map(answer)}
            )

    key_type = prompts.schema["query_id"].dataType.simpleString()
    return prompts.select("query_id", "messages").mapInPandas(
        run, f"query_id {key_type}, answer string"
    )
