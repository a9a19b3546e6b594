"""The operators composed into whole jobs, each one lazy plan."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow import config
from corpusflow.config import ChunkRules, ChunkSizes, Site, UrlExclusions
from corpusflow.functions.lineage import stored
from corpusflow.operators import chunks, conversation, embed, packing, retrieve, urls
from corpusflow.sources import tables


def discover_urls(
    *sources: DataFrame,
    site: Site,
    rules: UrlExclusions = config.DISCOVER_EXCLUSIONS,
) -> DataFrame:
    """The URL inventory: union, filters, dedup by canonical form, variants, sorted."""
    # The dedup below makes a distinct union unnecessary.
    found = reduce(DataFrame.unionByName, [source.select("url") for source in sources])
    allowed = urls.allow_domains(urls.exclude_system_urls(found, rules), site)
    unique = urls.dedup_urls(allowed, site.allowed_domains).select("url")
    return urls.drop_variant_urls(unique).orderBy("url")


def build_chunks(
    pages: DataFrame,
    sizes: ChunkSizes = ChunkSizes(),
    rules: ChunkRules = ChunkRules(),
) -> DataFrame:
    """Kept chunks of ingested pages: clean, chunk, classify, keep the first of each text.

    Everything up to the last step is narrow and runs once; the first places of texts are shuffled.
    """
    cleaned = chunks.clean_sections(pages)
    made = chunks.make_chunks(cleaned, sizes)
    return chunks.keep_first_chunks(chunks.classify_chunks(made, rules))


def answer_prompts(
    docs: DataFrame,
    questions: DataFrame,
    system_prompt: str,
    match_count: int = config.MATCH_COUNT,
    threshold: float = config.MATCH_THRESHOLD,
    budget: int = config.CONTEXT_BUDGET,
) -> DataFrame:
    """Prompts for fixed questions ``(query_id, question, embedding)``, without history.

    Questions without a match have no prompt; see ``retrieve.unanswered``.
    """
    matches = retrieve.match_documents(docs, questions, match_count, threshold)
    asked = questions.select("query_id", "question")
    answered = asked.join(matches.select("query_id").distinct(), "query_id", "left_semi")
    contexts = packing.pack_context(matches, answered, system_prompt, budget)
    return packing.assemble_prompts(contexts, answered, system_prompt)


def chat_prompts(
    turns: DataFrame,
    docs: DataFrame,
    embedded: Callable[[DataFrame], DataFrame],
    system_prompt: str,
    match_count: int = config.MATCH_COUNT,
    threshold: float = config.MATCH_THRESHOLD,
    budget: int = config.CONTEXT_BUDGET,
    history_budget: int = config.HISTORY_BUDGET,
    homepage_urls: tuple[str, ...] = (),
    find: Callable[..., DataFrame] = retrieve.match_documents,
) -> DataFrame:
    """Everything a chat does up to the model, for every user turn of ``turns``.

    The question with its earlier turns is searched for, the history is trimmed, the best
    matches are packed into what history and question leave of the budget, the source to show is
    picked from the packed rows, and the prompt is put together. Returns ``(query_id, search_text,
    history_tokens, n_selected, total_tokens, url, messages, answer)``: a turn without a match
    has no messages but the fixed answer, and others have no answer yet. ``url`` is NULL where no
    match was packed.

    ``embedded`` adds ``embedding`` to ``(query_id, question)``; ``find`` searches ``docs`` as
    ``match_documents`` does, or is a search of a stored index.
    """
    key = F.concat_ws("-", "conv_id", "turn").alias("query_id")
    asked = conversation.contextual_queries(turns).select(key, "question", "search_text")
    vectors = stored(
        embedded(asked.select("query_id", F.col("search_text").alias("question"))).select(
            "query_id", "embedding"
        )
    )
    # Matches go by number, as vectors and their winners do.
    numbered = stored(
        asked.join(vectors, "query_id").withColumn("number", F.monotonically_increasing_id())
    )
    by_number = numbered.select(F.col("number").alias("query_id"), "embedding")
    matches = (
        find(docs, by_number, match_count, threshold)
        .withColumnRenamed("query_id", "number")
        .join(numbered.select("number", "query_id"), "number")
        .drop("number")
    )
    matches = stored(matches)
    histories = conversation.trim_history(turns, history_budget).select(
        key, "history", "history_tokens"
    )
    queries = asked.join(histories, "query_id")
    known = matches.select("query_id").distinct()
    answered = queries.join(known, "query_id", "left_semi")
    # The contexts and the sources read the packed rows; matches with their texts are shuffled once.
    selected = stored(packing.select_matches(matches, answered, system_prompt, budget))
    contexts = packing.build_contexts(selected, answered, system_prompt)
    sources = retrieve.pick_source(selected, homepage_urls).select("query_id", "url")
    prompts = packing.assemble_prompts(contexts, answered, system_prompt, answered)
    return (
        queries.select("query_id", "search_text", "history_tokens")
        .join(contexts.select("query_id", "n_selected", "total_tokens"), "query_id", "left")
        .join(sources, "query_id", "left")
        .join(prompts, "query_id", "left")
        .withColumn("answer", F.when(F.col("messages").isNull(), config.NO_MATCH_ANSWER))
    )


def build_index(
    pages: DataFrame,
    path: str,
    embedder: embed.Embedder,
    sizes: ChunkSizes = ChunkSizes(),
    rules: ChunkRules = ChunkRules(),
    batch_size: int = config.EMBED_BATCH,
) -> DataFrame:
    """From ingested pages to the published index at ``path``, which replaces the one before.

    Returns ``(id, error)`` of every chunk; a failed call costs its own chunks only. The chunks are
    made and embedded once. Read the index with ``published``.
    """
    embedded = stored(embed.embed_chunks(build_chunks(pages, sizes, rules), embedder, batch_size))
    tables.load_documents(embedded, path)
    return embedded.select("id", "error")
