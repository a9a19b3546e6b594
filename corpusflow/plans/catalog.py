"""One registered query per operator, over the standard tables.

The tables declare no key between vectors and texts; by convention ``vec_id = doc_id``.
Word lists and small budgets replace the defaults where the defaults would select nothing
in this data. Results hold plain columns: arrays are joined to strings, timestamps are
microseconds.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.config import ChunkRules, ChunkSizes, Site
from corpusflow.functions.lineage import shared_folder
from corpusflow.operators import ann, chunks, conversation, embed, packing, pages, retrieve, urls
from corpusflow.plans import pipelines
from corpusflow.sources import tables
from corpusflow.sources.published import published
from corpusflow.session import ROCKSDB
from corpusflow.streaming import admission, page_log, page_stream, timing_stream

SITE = Site(
    start_url="http://thther.example.org",
    related_domains=("https://ththon.example.net", "https://cheap-pills.example.com"),
)
PAGE_TYPES = {"English": ("/en/",), "Paged": ("page=", "seite="), "Shop": ("cheap-", "shop")}
LISTING_TYPES = {"feed": ("=feed",), "anchor": ("#top",), "tag": ("/tag",)}
SPECIAL_PATTERNS = (r"page=\d+", r"^https://blog\.", "(unclosed")
RULES = ChunkRules(
    navigation_keywords=("thanedble", "worthless", "onrein", "the", "of", "and"),
    navigation_phrases=("eauouon", "aschi"),
    navigation_leads=("is re", "le o"),
    consent_keywords=("license", "copyright", "onthe", "ouaux", "keit"),
    fragment_endings=("the.", "la.", "en."),
    valuable_in_navigation=("thandst", "kl."),
    valuable_in_consent=("hahaha", "kl."),
)
SIZES = ChunkSizes(min_tokens=60, max_tokens=200, overlap_tokens=30, valuable_min_tokens=25,
                   valuable_words=("email", "kl.", "tion"))
BOILERPLATE_TEXT = (r"thth\s+", r"license", r"ouaux.*que")
BOILERPLATE_TITLE = (r"src1\d", r"es$")
HOMEPAGES = ("src0", "src1", "src2")
SYSTEM = "Answer from the context only."
K, THRESHOLD = 12, 0.25
# Cells per query of the stored index, which has one per label.
N_PROBE = 8
CONTEXT_TOKENS, HISTORY_TOKENS = 400, 200
# Few vectors are that similar, and a long history takes most of that budget.
CHAT_THRESHOLD, CHAT_TOKENS = 0.4, 300
RATE, WINDOW_SECONDS = 3, 86400
EVICT_AFTER = "1 minute"
# Calls of this size mostly succeed where a few texts hold a mail address.
BATCH = 20

# Tables with long texts, and the column to spread them by when they are small.
_SPREAD = {"documents": "doc_id", "pages": "page_id"}


def _new_folder(spark: SparkSession) -> str:
    """A fresh folder next to the checkpoints, for queries that write tables."""
    return f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    path = f"{sf}/{name}.parquet"
    if name in _SPREAD:
        return tables.read_table(spark, path, _SPREAD[name])
    return spark.read.parquet(path)


# -- inputs derived from the tables ----------------------------------------------------


def page_urls(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "pages").select(F.col("page_id").alias("ord"), "url")


def page_links(spark: SparkSession, sf: str) -> DataFrame:
    return urls.page_links(_read(spark, sf, "pages").select("url", "html"))


def page_links_relative(spark: SparkSession, sf: str) -> DataFrame:
    """The same pages with relative, unquoted and encoded targets."""
    html = F.col("html")
    for old, new in (('href="/t', 'href="../t'), ('href="/a', "href='./a"), ('href="/e', 'href="?e=1&amp;x=')):
        html = F.replace(html, F.lit(old), F.lit(new))
    html = F.regexp_replace(html, r"""href='(\./[^"]*)\"""", "href='$1'")
    return urls.page_links(_read(spark, sf, "pages").select("url", html.alias("html")))


def all_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Page URLs and link targets, with repeats."""
    links = page_links(spark, sf).select(F.col("link").alias("url"))
    return page_urls(spark, sf).select("url").unionByName(links)


def sitemaps(spark: SparkSession, sf: str) -> DataFrame:
    """One sitemap per page: its URL, two child sitemaps and two entries to drop."""

    def address(number: Column) -> Column:
        return F.concat(
            F.lit("https://site"), number.cast("string"), F.lit(".example/sitemap.xml")
        )

    number = F.col("page_id")
    return _read(spark, sf, "pages").select(
        address(number).alias("sitemap_url"),
        F.concat(
            F.lit("<urlset><loc> "), "url", F.lit(" </loc><loc></loc><loc>ftp://x</loc><loc>"),
            address(number + 1), F.lit("</loc><loc>"), address(number * 3),
            F.lit("</loc></urlset>"),
        ).alias("body"),
    )


def sitemap_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return (
        _read(spark, sf, "pages")
        .where(F.startswith("url", F.lit("https://www.")))
        .select(F.concat(F.lit("https://site"), "page_id", F.lit(".example")).alias("url"))
    )


def variant_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Page URLs without query, and numbered and duplicate variants of them."""
    base = F.regexp_replace("url", r"[?#].*$", "")
    stem = F.regexp_replace(base, "/$", "")
    return _read(spark, sf, "pages").select(
        F.explode(
            F.array(
                F.when(F.contains("url", F.lit("/en/")), base),
                F.concat(stem, F.lit("-2")),
                F.when(F.contains("url", F.lit("/fr/")), F.concat(stem, F.lit("-2/"))),
                F.when(F.contains("url", F.lit("/de/")), F.concat(stem, F.lit("-2-2"))),
                F.when(F.contains("url", F.lit("/es/")), F.concat(stem, F.lit("-duplicate"))),
            )
        ).alias("url")
    ).where("url is not null")


def document_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as pages: every line is a section."""
    sections = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.struct(
            F.concat(F.lit(" Part "), i).alias("section_title"), line.alias("text")
        ),
    )
    return _read(spark, sf, "documents").select(
        F.col("doc_id").alias("page_ord"), F.col("source").alias("source_url"),
        F.col("lang").alias("title"), sections.alias("sections"),
    )


def document_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as one section each."""
    section = F.struct(F.lit("").alias("section_title"), "text")
    return _read(spark, sf, "documents").select(
        F.col("doc_id").alias("page_ord"), F.col("source").alias("source_url"),
        F.col("lang").alias("title"), F.array(section).alias("sections"),
    )


def document_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as chunks, one each."""
    return _read(spark, sf, "documents").select(
        F.concat(F.lit("doc-"), "doc_id").alias("id"),
        F.col("text").alias("content"), F.col("source").alias("source_url"),
        F.col("lang").alias("title"), F.col("source").alias("section"),
        F.lit(0).alias("chunk_index"), F.col("doc_id").alias("page_ord"),
        F.lit(0).alias("section_index"),
    )


def short_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of a document as a chunk."""
    return (
        _read(spark, sf, "documents")
        .select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")))
        .select(
            F.concat_ws("-", F.lit("line"), "doc_id", "pos").alias("id"),
            F.col("col").alias("content"), F.col("source").alias("source_url"),
            F.col("lang").alias("title"), F.col("source").alias("section"),
            F.col("pos").alias("chunk_index"), F.col("doc_id").alias("page_ord"),
            F.lit(0).alias("section_index"),
        )
    )


def raw_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as raw pages: a title line, a lost preamble, then one section per line."""
    return _read(spark, sf, "documents").select(
        F.col("doc_id").alias("page_ord"),
        F.concat(F.lit("https://"), "source", F.lit("/"), "doc_id").alias("url"),
        F.lit(None).cast("string").alias("source_url"),
        F.concat(
            F.lit("# "), "source", F.lit("\n\n"),
            F.regexp_replace("text", "\n", "\n## About it\n- item\n1. first step!\n"),
        ).alias("markdown"),
        F.struct(
            F.col("lang").alias("title"), F.lit(None).cast("string").alias("source_url")
        ).alias("metadata"),
    )


def index(spark: SparkSession, sf: str) -> DataFrame:
    """The document index: vectors with text."""
    documents = _read(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("content"),
        F.col("source").alias("source_url"), F.col("lang").alias("title"),
        F.lit("").alias("section"),
    )
    return _read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding").join(
        documents, "id"
    )


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector as a query."""
    return _read(spark, sf, "embeddings").select(
        F.col("vec_id").alias("query_id"),
        F.concat(F.lit("Question about group "), "label").alias("question"),
        "embedding",
    )


def asked(spark: SparkSession, sf: str) -> DataFrame:
    return questions(spark, sf).select("query_id", "question")


def matches(spark: SparkSession, sf: str) -> DataFrame:
    return retrieve.match_documents(index(spark, sf), questions(spark, sf), K, THRESHOLD)


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "conversations")


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "events").select(
        F.col("event_id").alias("request_id"), F.col("user_id").alias("client"), "ts"
    )


def vowel_counts(texts: list[str]) -> list[list[float]]:
    """A model simple enough to state in SQL: how often each vowel occurs."""
    return [[float(text.count(vowel)) for vowel in "aeiou"] for text in texts]


def vowel_counts_without_mail(texts: list[str]) -> list[list[float]]:
    if any("@" in text for text in texts):
        raise ValueError("mail address")
    return vowel_counts(texts)


def _turn_list(history: str) -> Column:
    return F.array_join(
        F.transform(
            history,
            lambda row: F.concat_ws("|", row["turn"].cast("string"), row["role"], row["text"]),
        ),
        "\n",
    )


def _section_list(sections: str) -> Column:
    return F.array_join(
        F.transform(sections, lambda s: F.concat_ws("|", s["section_title"], s["text"])), "\n"
    )


# -- queries ---------------------------------------------------------------------------


def sitemap_locs(spark, sf):
    return urls.sitemap_locs(sitemaps(spark, sf))


def expand_sitemaps(spark, sf):
    return urls.expand_sitemaps(sitemap_seeds(spark, sf), sitemaps(spark, sf))


def normalize_urls(spark, sf):
    return urls.normalize_urls(all_urls(spark, sf), SITE.allowed_domains)


def exclude_system_urls(spark, sf):
    return urls.exclude_system_urls(
        all_urls(spark, sf).select(
            F.explode(
                F.array(
                    "url",
                    F.concat(F.regexp_replace("url", "/(en|de)/", "/Admin/"), F.lit("x")),
                    F.concat("url", F.lit("/page-sitemap.xml")),
                    F.concat("url", F.lit("/sitemap/a")),
                )
            ).alias("url")
        )
    )


def exclude_crawl_urls(spark, sf):
    from corpusflow.config import CRAWL_EXCLUSIONS

    return urls.exclude_system_urls(
        all_urls(spark, sf).select(
            F.explode(
                F.array("url", F.regexp_replace("url", "/fr/", "/xml/"),
                        F.concat("url", F.lit("/sitemap/a")))
            ).alias("url")
        ),
        CRAWL_EXCLUSIONS,
    )


def allow_domains(spark, sf):
    return urls.allow_domains(all_urls(spark, sf), SITE)


def dedup_urls(spark, sf):
    return urls.dedup_urls(all_urls(spark, sf), SITE.allowed_domains)


def drop_variant_urls(spark, sf):
    return urls.drop_variant_urls(variant_urls(spark, sf))


def union_urls(spark, sf):
    return urls.union_urls(
        page_urls(spark, sf),
        page_links(spark, sf).select(F.col("link").alias("url")),
        variant_urls(spark, sf),
    )


def url_summary(spark, sf):
    found = urls.union_urls(all_urls(spark, sf))
    return urls.url_summary(found, discover_urls(spark, sf), SITE)


def page_type_coverage(spark, sf):
    return urls.page_type_coverage(all_urls(spark, sf), PAGE_TYPES, LISTING_TYPES)


def discover_urls(spark, sf):
    return pipelines.discover_urls(
        page_urls(spark, sf), page_links(spark, sf).select(F.col("link").alias("url")), site=SITE
    )


def plan_crawl(spark, sf):
    stripped = page_urls(spark, sf).withColumn("url", F.regexp_replace("url", r"[?#].*$", ""))
    crawled = page_urls(spark, sf).select(F.col("url").alias("source_url"))
    return pages.plan_crawl(stripped, crawled, SITE.start_url)


def plan_crawl_limited(spark, sf):
    """A limit that cuts at every size."""
    stripped = page_urls(spark, sf).withColumn("url", F.regexp_replace("url", r"[?#].*$", ""))
    crawled = page_urls(spark, sf).select(F.col("url").alias("source_url"))
    return pages.plan_crawl(stripped, crawled, SITE.start_url, limit=20)


def tag_special_pages(spark, sf):
    return pages.tag_special_pages(page_urls(spark, sf), SPECIAL_PATTERNS)


def best_attempt(spark, sf):
    return pages.best_attempt(
        _read(spark, sf, "documents").select(
            F.col("source").alias("url"), F.col("doc_id").alias("attempt"),
            F.col("text").alias("markdown"),
        )
    )


def pages_to_markdown(spark, sf):
    return pages.pages_to_markdown(_read(spark, sf, "pages")).select(
        "page_ord", "url", "markdown", F.col("metadata.title").alias("title")
    )


def _sections(spark, sf, keep_all: bool) -> DataFrame:
    extracted = pages.extract_sections(
        raw_pages(spark, sf), keep_all, BOILERPLATE_TEXT, BOILERPLATE_TITLE
    )
    return extracted.select(
        "page_ord", "source_url", "title", F.size("sections").alias("n_sections"),
        _section_list("sections").alias("sections"),
    )


def extract_sections(spark, sf):
    return _sections(spark, sf, True)


def extract_content_sections(spark, sf):
    return _sections(spark, sf, False)


def page_sections(spark, sf):
    """Raw HTML to sections, end to end."""
    markdown = pages.pages_to_markdown(_read(spark, sf, "pages"))
    return pages.extract_sections(markdown).select(
        "page_ord", "source_url", "title", _section_list("sections").alias("sections")
    )


def _old_and_new_pages(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Documents as existing pages; the good ones not in English as newly crawled."""

    def as_pages(df: DataFrame, title: Column) -> DataFrame:
        slash = F.when(F.col("n_chars") > 3000, "/").otherwise("")
        return df.select(
            F.col("doc_id").alias("page_ord"),
            F.concat(F.lit("https://"), "source", F.lit("/"), "lang", slash).alias("source_url"),
            title.alias("title"),
            F.array(F.struct(F.lit("").alias("section_title"), "text")).alias("sections"),
        )

    documents = _read(spark, sf, "documents")
    labelled = documents.join(_read(spark, sf, "labels").where("quality = 1"), "doc_id")
    return (
        as_pages(documents, F.concat(F.lit("old "), "doc_id")),
        as_pages(labelled.where("lang <> 'en'"), F.concat(F.lit("new "), "doc_id")),
    )


def upsert_pages(spark, sf):
    merged = pages.upsert_pages(*_old_and_new_pages(spark, sf))
    return merged.select("url_key", "page_ord", "title", F.col("sections")[0]["text"].alias("text"))


def upsert_page_batches(spark, sf):
    """Two micro-batches merged into a bucketed table."""
    table = f"{_new_folder(spark)}/pages"
    for batch in _old_and_new_pages(spark, sf):
        page_stream.upsert_batch(batch, table, 8)
    return spark.read.parquet(table).select(
        F.regexp_replace("source_url", "/$", "").alias("url_key"), "page_ord", "title",
        F.col("sections")[0]["text"].alias("text"),
    )


def upsert_page_stream(spark, sf):
    """Documents as crawled pages from a stream that comes in four parts, a micro-batch each, into a log.

    It is compacted after three batches; the fourth is merged when the table is read.
    """
    folder = _new_folder(spark)
    documents, _ = _old_and_new_pages(spark, sf)
    for part in range(4):
        # Positions begin anew in every batch.
        rows = documents.where(F.col("page_ord") % 4 == part)
        rows = rows.withColumn("page_ord", F.floor(F.col("page_ord") / 4))
        rows.write.mode("append").parquet(f"{folder}/crawled")
        stream = spark.readStream.schema(documents.schema).parquet(f"{folder}/crawled")
        # The stream goes on from its checkpoint and takes a part's files as one batch.
        query = page_log.upsert_log_stream(
            stream, f"{folder}/pages", f"{folder}/state", 3, availableNow=True
        )
        query.awaitTermination()
    return page_log.read_page_log(spark, f"{folder}/pages").select(
        "url_key", "page_ord", "title", F.col("sections")[0]["text"].alias("text")
    )


def page_stats(spark, sf):
    return pages.page_stats(document_pages(spark, sf))


def crawl_outcome(spark, sf):
    return pages.crawl_outcome(
        _read(spark, sf, "events").select(
            F.col("event_id").cast("string").alias("url"), F.col("event_type").alias("status")
        )
    )


def clean_sections(spark, sf):
    return chunks.clean_sections(document_pages(spark, sf), ("worthless", "ertion", "keit"))


def make_chunks(spark, sf):
    return chunks.make_chunks(chunks.clean_sections(document_sections(spark, sf)), SIZES)


def classify_chunks(spark, sf):
    return chunks.classify_chunks(short_chunks(spark, sf), RULES).select(
        "page_ord", "chunk_index", "reason"
    )


def dedup_chunks(spark, sf):
    classified = chunks.classify_chunks(short_chunks(spark, sf), RULES)
    return chunks.dedup_chunks(classified).select("page_ord", "chunk_index", "reason")


def keep_first_chunks(spark, sf):
    return chunks.keep_first_chunks(chunks.classify_chunks(short_chunks(spark, sf), RULES)).select(
        "page_ord", "chunk_index", "content"
    )


def cleaning_report(spark, sf):
    source = document_pages(spark, sf)
    cleaned = chunks.clean_sections(source, ())
    tagged = chunks.dedup_chunks(chunks.classify_chunks(short_chunks(spark, sf), RULES))
    return chunks.cleaning_report(source, cleaned, tagged)


def build_chunks(spark, sf):
    return pipelines.build_chunks(document_sections(spark, sf), SIZES, RULES)


def classify_chunks_defaults(spark, sf):
    """Lines by the rules as they come."""
    return chunks.classify_chunks(short_chunks(spark, sf)).select("page_ord", "chunk_index", "reason")


def build_chunks_defaults(spark, sf):
    """Chunks by the rules and sizes as they come."""
    return pipelines.build_chunks(document_sections(spark, sf))


def embed_summary_defaults(spark, sf):
    """Failures with the default number of texts a call."""
    return embed.embed_summary(
        embed.embed_chunks(document_chunks(spark, sf), vowel_counts_without_mail)
    )


def embed_chunks(spark, sf):
    embedded = embed.embed_chunks(document_chunks(spark, sf), vowel_counts)
    counts = F.transform("embedding", lambda x: x.cast("int").cast("string"))
    return embedded.select("id", F.array_join(counts, ",").alias("vector"), "error")


def embed_summary(spark, sf):
    return embed.embed_summary(
        embed.embed_chunks(document_chunks(spark, sf), vowel_counts_without_mail, BATCH)
    )


def first_errors(spark, sf):
    return embed.first_errors(
        embed.embed_chunks(document_chunks(spark, sf), vowel_counts_without_mail, BATCH)
    )


def load_documents(spark, sf):
    """The index refreshed twice; the second load replaces the first."""
    table = f"{_new_folder(spark)}/index"
    embedded = embed.embed_chunks(
        document_chunks(spark, sf), vowel_counts_without_mail, BATCH
    )
    tables.load_documents(embedded, table)
    replaced = tables.load_documents(embedded, table)
    return published(spark, table).select(
        "content", "source_url", "title", "section", F.lit(replaced).cast("bigint").alias("replaced")
    )


def match_documents(spark, sf):
    return matches(spark, sf).withColumn("similarity", F.round("similarity", 6))


def _stored_index(spark, sf):
    """The stored index of the vectors, one cell per label; built once per application."""
    path = f"{shared_folder(spark)}/index-{hashlib.sha256(sf.encode('utf-8')).hexdigest()}"
    if not tables.path_exists(spark, f"{path}/settings/_SUCCESS"):
        vectors = _read(spark, sf, "embeddings")
        centroids = ann.mean_centroids(vectors, "label")
        docs = vectors.select(F.col("vec_id").alias("id"), "embedding")
        return ann.build_ann_index(docs, path, centroids, N_PROBE)
    return ann.open_ann_index(spark, path)


def _approx_matches(spark, sf, n_probe=None, block_bytes=retrieve.BLOCK_BYTES):
    found = ann.search(
        _stored_index(spark, sf), questions(spark, sf), K, THRESHOLD, n_probe, block_bytes
    )
    return found.select("query_id", "rank", "id", F.round("similarity", 6).alias("similarity"))


def build_ann_index(spark, sf):
    """Which cell every vector is stored in."""
    return _stored_index(spark, sf).vectors.select("id", "cell")


def approx_match_documents(spark, sf):
    return _approx_matches(spark, sf)


def approx_match_blocks(spark, sf):
    """The same search with blocks of 400 queries: queries go to the documents' slots."""
    return _approx_matches(spark, sf, block_bytes=8 * 64 * 400)


def approx_match_all_cells(spark, sf):
    """Probing every cell is exact search; here with an index trained on a sample of its vectors."""
    docs, n_cells = index(spark, sf), 16
    found = retrieve.approx_match_documents(
        docs, questions(spark, sf), retrieve.train_centroids(docs, n_cells), n_cells, K, THRESHOLD
    )
    return found.select("query_id", "rank", "id", F.round("similarity", 6).alias("similarity"))


def approx_recall(spark, sf):
    """Per query, how many of the exact matches among all vectors the stored index finds."""
    vectors = _read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    exact = retrieve.match_documents(vectors, questions(spark, sf), K, THRESHOLD)
    return retrieve.recall(exact, _approx_matches(spark, sf))


def conversation_history(spark, sf):
    history = conversation.conversation_history(turns(spark, sf), "Nicht")
    return history.select(
        "conv_id", "turn", "question", F.size("history").alias("n"),
        _turn_list("history").alias("history"),
    )


def contextual_queries(spark, sf):
    return conversation.contextual_queries(turns(spark, sf), 25, 300, 120)


def trim_history(spark, sf):
    trimmed = conversation.trim_history(turns(spark, sf), HISTORY_TOKENS)
    return trimmed.select(
        "conv_id", "turn", "history_tokens", _turn_list("history").alias("history")
    )


def trim_history_pairs_first(spark, sf):
    trimmed = conversation.trim_history(turns(spark, sf), HISTORY_TOKENS, reference_order=True)
    return trimmed.select("conv_id", "turn", _turn_list("history").alias("history"))


def select_matches(spark, sf):
    return packing.select_matches(
        matches(spark, sf), asked(spark, sf), SYSTEM, CONTEXT_TOKENS
    ).select("query_id", "rank", "id", "truncated", "content")


def pack_context(spark, sf):
    return packing.pack_context(matches(spark, sf), asked(spark, sf), SYSTEM, CONTEXT_TOKENS)


def pick_source(spark, sf):
    return retrieve.pick_source(matches(spark, sf), HOMEPAGES)


def assemble_prompts(spark, sf):
    """Conversation prompts: each user turn with its trimmed history and, as the context,
    the question itself."""
    trimmed = conversation.trim_history(turns(spark, sf), HISTORY_TOKENS).withColumn(
        "query_id", F.concat_ws("-", "conv_id", "turn")
    )
    context = F.concat(F.lit("[1] "), "question")
    prompts = packing.assemble_prompts(
        trimmed.select("query_id", context.alias("context")), trimmed, SYSTEM, trimmed
    )
    return prompts.select(
        "query_id",
        F.array_join(
            F.transform("messages", lambda m: F.concat_ws("|", m["role"], m["content"])), "\n"
        ).alias("messages"),
    )


def _vector_of_text(spark, sf):
    """Stands for a model: the stored vector whose number the text's digest gives."""
    vectors = _read(spark, sf, "embeddings").select(F.col("vec_id").alias("number"), "embedding")
    n = vectors.count()

    def embedded(texts: DataFrame) -> DataFrame:
        digest = F.conv(F.substring(F.md5("question"), 1, 8), 16, 10).cast("long")
        return texts.withColumn("number", digest % n).join(vectors, "number").drop("number")

    return embedded


def chat_prompts(spark, sf):
    """Every user turn through search, history, packing and source; some have no match, and
    some histories leave no room for a context."""
    prompts = pipelines.chat_prompts(
        turns(spark, sf), index(spark, sf), _vector_of_text(spark, sf), SYSTEM, K,
        CHAT_THRESHOLD, CHAT_TOKENS, HISTORY_TOKENS, HOMEPAGES,
    )
    return prompts.withColumn(
        "messages",
        F.array_join(
            F.transform("messages", lambda m: F.concat_ws("|", m["role"], m["content"])), "\n"
        ),
    )


def build_index(spark, sf):
    """From pages to the published index, with the default number of texts a call."""
    path = f"{_new_folder(spark)}/index"
    outcome = pipelines.build_index(
        document_sections(spark, sf), path, vowel_counts_without_mail, SIZES, RULES
    )
    failed = outcome.where("error is not null").count()
    counts = F.transform("embedding", lambda x: x.cast("int").cast("string"))
    return published(spark, path).select(
        "content", "source_url", "title", "section", F.array_join(counts, ",").alias("vector"),
        F.lit(failed).alias("failed"),
    )


def _cache(spark, sf):
    first = turns(spark, sf).where("role = 'user' and turn = 0")
    return first.groupBy(F.col("text").alias("question")).agg(
        F.concat(F.lit("cached answer of "), F.min("conv_id")).alias("answer")
    )


def _asked_turns(spark, sf):
    return turns(spark, sf).where("role = 'user'").select(
        "conv_id", "turn", F.col("text").alias("question")
    )


def cache_lookup(spark, sf):
    return retrieve.cache_lookup(_asked_turns(spark, sf), _cache(spark, sf))


def cache_misses(spark, sf):
    return retrieve.cache_misses(_asked_turns(spark, sf), _cache(spark, sf))


def answer_cache_inputs(spark, sf):
    prompts = pipelines.answer_prompts(
        index(spark, sf), questions(spark, sf), SYSTEM, K, THRESHOLD, CONTEXT_TOKENS
    )
    return prompts.select(
        "query_id",
        F.col("messages")[0]["content"].alias("system"),
        F.col("messages")[1]["content"].alias("user"),
    )


def generated_answers(spark, sf):
    prompts = pipelines.answer_prompts(
        index(spark, sf), questions(spark, sf), SYSTEM, K, THRESHOLD, CONTEXT_TOKENS
    )

    def generator(messages: list[dict]) -> str:
        if "group 3" in messages[-1]["content"]:
            raise ValueError("no answer")
        return f"{len(messages)} messages, {len(messages[-1]['content'])} characters"

    return packing.generate_answers(prompts, generator)


def unanswered(spark, sf):
    good = _read(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    found = retrieve.match_documents(
        index(spark, sf).join(good, "id"), questions(spark, sf), K, 0.6
    )
    return retrieve.unanswered(asked(spark, sf), found)


def retrieval_metrics(spark, sf):
    found = matches(spark, sf)
    contexts = packing.pack_context(found, asked(spark, sf), SYSTEM, CONTEXT_TOKENS)
    return packing.retrieval_metrics(found, contexts, CONTEXT_TOKENS).withColumn(
        "top_similarity", F.round("top_similarity", 6)
    )


def sanitize_messages(spark, sf):
    marked = turns(spark, sf).withColumn(
        "text",
        F.concat(
            F.lit("See https://a.example/x?y=1 or [here](https://b.example) [Kilde 12]. "),
            "text",
            F.lit(" Basert på kilde en. <b>Mail</b> post@a.example og BASERT PÅ x."),
        ),
    )
    return conversation.sanitize_messages(marked).select("conv_id", "turn", "clean_text")


def _quarters(events: DataFrame) -> list:
    """Three times that cut the span of the events into four."""
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    return [first + (last - first) * k / 4 for k in (1, 2, 3)]


def rate_limit_stream(spark, sf):
    """The same decisions from a stream of the events in five parts, a micro-batch each.

    State is evicted. The last part has all requests of every tenth client, most of them later
    than the watermark.
    """
    folder = _new_folder(spark)
    # One state store per core.
    settings = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.shuffle.partitions": str(spark.sparkContext.defaultParallelism),
        # What is evicted is evicted with the next part.
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        events = _read(spark, sf, "events").select(
            F.col("event_id").alias("request_id"), F.col("user_id").alias("client"), "ts"
        )
        late = F.coalesce(F.pmod(F.xxhash64("client"), F.lit(10)) == 0, F.lit(False))
        in_time = events.where(~late)
        parts = []
        cuts = _quarters(events)
        for low, high in zip([None, *cuts], [*cuts, None], strict=True):
            part = in_time if low is None else in_time.where(F.col("ts") >= low)
            parts.append(part if high is None else part.where(F.col("ts") < high))
        for part in [*parts, events.where(late)]:
            part.write.mode("append").parquet(f"{folder}/events")
            stream = spark.readStream.schema(events.schema).parquet(f"{folder}/events")
            # The stream goes on from its checkpoint and takes a part's files as one batch.
            query = (
                admission.rate_limit_stream(stream, RATE, WINDOW_SECONDS, EVICT_AFTER)
                .writeStream.option("checkpointLocation", f"{folder}/state")
                .trigger(availableNow=True)
                .format("parquet")
                .start(f"{folder}/decisions")
            )
            query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return spark.read.parquet(f"{folder}/decisions").select(
        "request_id", "client", "allowed", "remaining",
        F.unix_micros("reset_at").alias("reset_at_us"), "retry_after",
    )


def client_keys(spark, sf):
    user = F.col("user_id").cast("string")
    kind = F.col("event_type")
    headers = _read(spark, sf, "events").select(
        F.col("event_id").alias("request_id"), "ts",
        F.when(kind == "click", F.concat(F.lit(" 10.0.0."), user, F.lit(", 10.1.1.1")))
        .when(kind == "view", F.lit("")).when(kind == "error", F.lit(",10.2.2.2")).alias("xff"),
        F.when(kind == "view", F.concat(F.lit("172.16.0."), user)).alias("real_ip"),
        F.when(F.col("value") > 10, F.concat(F.lit("192.168.0."), user)).alias("cdn_ip"),
    )
    return admission.with_client_key(headers).select("request_id", "client")


def rate_limit(spark, sf):
    decided = admission.rate_limit(requests(spark, sf), RATE, WINDOW_SECONDS)
    return decided.select(
        "request_id", "client", "allowed", "remaining",
        F.unix_micros("reset_at").alias("reset_at_us"), "retry_after",
    )


def timing_windows_stream(spark, sf):
    """Daily windows of a stream of four files, and whether their quantiles are of the right rank.

    Exact counts and sums; the share of requests below the sketch's median and 95th percentile
    must be what it should be, within three times the sketch's error. The last row is all days
    merged.
    """
    folder = _new_folder(spark)
    timings = _timings(spark, sf, F.col("ts").cast("timestamp").alias("ts"))
    cuts = _quarters(timings)
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = timings if low is None else timings.where(F.col("ts") >= low)
        part = part if high is None else part.where(F.col("ts") < high)
        part.coalesce(1).write.mode("append").parquet(f"{folder}/timings")
    stream = (
        spark.readStream.schema(timings.schema)
        .option("maxFilesPerTrigger", 1)
        .parquet(f"{folder}/timings")
    )
    timing_stream.timing_stream(
        stream, f"{folder}/windows", f"{folder}/state", "1 day", "1 day", availableNow=True
    ).awaitTermination()
    windows = timing_stream.read_timing_windows(spark, f"{folder}/windows")
    days = timing_stream.merged_timings(windows, F.col("window_start"))
    total = timing_stream.merged_timings(windows, F.lit(None).cast("timestamp").alias("window_start"))
    found = days.unionByName(total)
    of_day = timings.withColumn("window_start", F.window("ts", "1 day")["start"])
    both = of_day.unionByName(of_day.withColumn("window_start", F.lit(None).cast("timestamp")))
    both = both.withColumnRenamed("window_start", "of")
    margin = 3 * timing_stream.rank_error()

    def right(share: float, name: str) -> Column:
        below = F.avg((F.col("total_ms") < F.col(name)).cast("double"))
        up_to = F.avg((F.col("total_ms") <= F.col(name)).cast("double"))
        return (below <= share + margin) & (up_to >= share - margin)

    return (
        both.join(F.broadcast(found), F.col("of").eqNullSafe(F.col("window_start")))
        .groupBy(F.unix_micros("window_start").alias("window_us"), "requests", F.round("avg_ms", 6).alias("avg_ms"))
        .agg(right(0.5, "median_ms").alias("median_right"), right(0.95, "p95_ms").alias("p95_right"))
    )


def _timings(spark, sf, *more):
    log = _read(spark, sf, "events").select(
        F.col("event_id").alias("request_id"),
        F.floor("value").alias("embedding_ms"),
        F.floor(F.col("value") * 10).alias("search_ms"),
        F.when(F.col("event_type") == "click", F.lit(250)).alias("chat_ms"),
        *more,
    )
    return admission.request_timings(log)


def request_timings(spark, sf):
    return _timings(spark, sf).select("request_id", "total_ms")


def timing_summary(spark, sf):
    return admission.timing_summary(_timings(spark, sf), accuracy=1_000_000).withColumn(
        "avg_ms", F.round("avg_ms", 6)
    )


def pages_from_json(spark, sf):
    """Pages written as JSON arrays of fifty, and read back."""
    entry = F.struct("source_url", "title", "sections")
    files = (
        document_pages(spark, sf)
        .groupBy(F.floor(F.col("page_ord") / 50).alias("file_ord"))
        .agg(F.array_sort(F.collect_list(F.struct("page_ord", entry.alias("page")))).alias("rows"))
        .select("file_ord", F.to_json(F.col("rows.page")).alias("value"))
    )
    return tables.pages_from_json(files).select(
        "page_ord", "source_url", "title", _section_list("sections").alias("sections")
    )


def urls_from_json(spark, sf):
    files = (
        page_urls(spark, sf)
        .groupBy(F.floor(F.col("ord") / 50).alias("file_ord"))
        .agg(F.array_sort(F.collect_list(F.struct("ord", "url"))).alias("rows"))
        .select("file_ord", F.to_json(F.col("rows.url")).alias("value"))
    )
    return tables.urls_from_json(files)


def chunks_from_json(spark, sf):
    columns = ["id", "content", "source_url", "title", "section", "chunk_index"]
    files = (
        document_chunks(spark, sf)
        .groupBy(F.floor(F.col("page_ord") / 50).alias("file_ord"))
        .agg(
            F.array_sort(
                F.collect_list(F.struct("page_ord", F.struct(*columns).alias("chunk")))
            ).alias("rows")
        )
        .select("file_ord", F.to_json(F.col("rows.chunk")).alias("value"))
    )
    return tables.chunks_from_json(files).select("page_ord", *columns)


def _answers(spark, sf):
    return _read(spark, sf, "benchmark").select(
        F.col("item_id").alias("ord"), F.col("text").alias("question"),
        F.concat(F.lit('Answer "'), "item_id", F.lit('"')).alias("answer"),
    )


def answer_cache_objects(spark, sf):
    return tables.answer_cache_objects(_answers(spark, sf), 25)


def answers_from_json(spark, sf):
    objects = tables.answer_cache_objects(_answers(spark, sf), 25)
    return tables.answers_from_json(objects.select(F.col("json").alias("value")))


def read_pages(spark, sf):
    """Pages written as JSON lines, and read back; the order of files is not that of pages."""
    path = _new_folder(spark)
    tables.write_table(document_pages(spark, sf).drop("page_ord"), path, "json")
    return tables.read_pages(spark, path).select(
        "source_url", "title", _section_list("sections").alias("sections")
    )


def read_urls(spark, sf):
    """URLs written as JSON arrays of fifty, a file each, and read back."""
    path = _new_folder(spark)
    arrays = (
        page_urls(spark, sf)
        .groupBy(F.floor(F.col("ord") / 50).alias("file_ord"))
        .agg(F.array_sort(F.collect_list(F.struct("ord", "url"))).alias("rows"))
        .select(F.to_json(F.col("rows.url")).alias("value"))
    )
    arrays.repartition(F.xxhash64("value")).write.option("maxRecordsPerFile", 1).text(path)
    return tables.read_urls(spark, path).select("url")


def read_chunks(spark, sf):
    path = _new_folder(spark)
    columns = ["id", "content", "source_url", "title", "section", "chunk_index"]
    tables.write_table(document_chunks(spark, sf).select(*columns), path, "json")
    return tables.read_chunks(spark, path).select(*columns)


def read_answer_cache(spark, sf):
    """Answers written as objects of counted size, a file each, and read back."""
    path = _new_folder(spark)
    tables.write_answer_cache(_answers(spark, sf), path, 25)
    return tables.read_answer_cache(spark, path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        pages_from_json, urls_from_json, chunks_from_json, answers_from_json,
        read_pages, read_urls, read_chunks, read_answer_cache,
        answer_cache_objects,
        sitemap_locs, expand_sitemaps, page_links, page_links_relative, normalize_urls, exclude_system_urls,
        exclude_crawl_urls, allow_domains, dedup_urls, drop_variant_urls, union_urls,
        url_summary, page_type_coverage, discover_urls,
        plan_crawl, plan_crawl_limited, tag_special_pages, best_attempt, pages_to_markdown, extract_sections,
        extract_content_sections, page_sections, upsert_pages, upsert_page_batches,
        upsert_page_stream, page_stats, crawl_outcome,
        clean_sections, make_chunks, classify_chunks, dedup_chunks, keep_first_chunks,
        cleaning_report, build_chunks,
        classify_chunks_defaults, build_chunks_defaults, embed_summary_defaults,
        embed_chunks, embed_summary, first_errors, load_documents,
        match_documents, build_ann_index, approx_match_documents, approx_match_blocks,
        approx_match_all_cells, approx_recall,
        conversation_history, contextual_queries, trim_history, trim_history_pairs_first,
        select_matches, pack_context, pick_source, assemble_prompts, cache_lookup,
        cache_misses, chat_prompts, build_index, answer_cache_inputs, generated_answers, unanswered,
        retrieval_metrics, sanitize_messages,
        rate_limit, rate_limit_stream, client_keys, request_timings, timing_summary,
        timing_windows_stream,
    )
}
