"""One registered query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import (
    bpe,
    decontaminate,
    divergence,
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

COUNT_FILE = "byte_bpe_50k.json"
ENCODE_FILE = "word_bpe_49k.json"
PIECE_FILE = "piece_bpe_32k.model"
MAX_TOKENS = 512
# Where the tokenizer has the worker for itself; the pipeline keeps to the smaller default.
CACHED_WORDS = 300_000
PII_KEY = "a key from the secret store goes here"


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def n_bytes(text: str = "text"):
    return F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long"))


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored in a media container, inspected, read back and digested."""
    docs = documents(spark, sf_dir).select("doc_id", "text", n_bytes().alias("n_bytes"))
    stored = media.store(docs).drop("text")
    read = media.inspect_and_read(stored)
    info = F.col("info")
    keys = info["keyframes"]
    ranges = F.transform(keys, lambda k: F.concat_ws("+", k["offset"], k["size"]))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(
            ";",
            info["codec"],
            F.concat_ws("x", info["width"], info["height"]),
            F.concat(F.lit("samples="), info["n_samples"]),
            F.concat(F.lit("duration="), F.format_string("%.2f", info["duration_s"])),
            F.concat(F.lit("keyframes="), F.array_join(ranges, ",")),
        ).alias("feature"),
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item in every document: edits, and where its passage begins."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_leaks(docs, items).select("doc_id", F.explode("leaks").alias("leak"))
    return found.select("doc_id", "leak.*")


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text; digests of the ids and of the decoded text."""
    path = tokenizer_file(ENCODE_FILE)
    docs = documents(spark, sf_dir).select("doc_id", "text")
    coded = bpe.encode_and_decode(docs, path, cached_words=CACHED_WORDS)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every text that repeat a string of 100 bytes from earlier on, and what is left."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = substrings.repeated_substrings(docs)
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate texts: three-word shingles, similarity of 0.85 or more."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return near.near_duplicates(docs, width=3, percent=85)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every text, and whether it is over the limit."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    counted = bpe.count_tokens(docs, tokenizer_file(COUNT_FILE), cached_words=CACHED_WORDS)
    return counted.select(
        "doc_id",
        n_bytes().alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > MAX_TOKENS).alias("over_limit"),
    )


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text: counts of the base kinds, their digest and all spans."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = secrets.scan_secrets(docs).drop("text")

    def of(*kinds: str):
        return F.filter("secrets", lambda s: s["kind"].isin(*kinds))

    def joined(spans):
        texts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
        return F.array_join(texts, ",")

    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in secrets.BASE_KINDS],
        F.sha2(joined(of(*secrets.BASE_KINDS)), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every text, learned from weak labels of the same texts."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs))
    return scored.select("doc_id", "n_words", "quality_score", "kept")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its personal data replaced by pseudonyms of the same format."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    masked = pii.pseudonymize(docs, PII_KEY)
    return masked.select(
        "doc_id",
        F.size("pii").cast("long").alias("n_replaced"),
        F.array_join("pii", ",").alias("kinds"),
        "text",
    )


def language_content(spark: SparkSession, sf_dir: str) -> dict[str, bytes]:
    """Dictionaries learned from the documents that are not held out."""
    return language.fit(documents(spark, sf_dir).where(~language.held_out()))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text."""
    content = language_content(spark, sf_dir)
    docs = documents(spark, sf_dir).select("doc_id", "text", language.held_out().alias("held_out"))
    return language.identify(docs, content).select(
        "doc_id", "held_out", "lang_pred", "score", "rejected"
    )


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far every source departs from the others of its language, and by which terms."""
    return divergence.audit(documents(spark, sf_dir).select("text", "lang", "source"))


def op12_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text by pieces; digests of the ids and of the decoded text."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    path = tokenizer_file(PIECE_FILE)
    coded = pieces.encode(docs, path, decoded="decoded", keep_text=False)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cut in three for fill-in-middle training, and put together again."""
    cut = infill.fill_in_middle(documents(spark, sf_dir).select("doc_id", "text"))
    return cut.select(
        "doc_id",
        F.col("n_units").alias("n"),
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(infill.restored("output", "form"), 256).alias("restored_sha256"),
    )


QUERIES = {
    "op1_media": op1_media,
    "op2_decontamination": op2_decontamination,
    "op3_bpe_codec": op3_bpe_codec,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_token_counts": op6_token_counts,
    "op7_secrets": op7_secrets,
    "op8_quality": op8_quality,
    "op9_pii": op9_pii,
    "op10_language": op10_language,
    "op11_source_divergence": op11_source_divergence,
    "op12_piece_codec": op12_piece_codec,
    "op13_fill_in_middle": op13_fill_in_middle,
}

_DIVERGENCE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         unnest(list_concat([''], regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
  FROM documents),
counts AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT row) AS docs FROM docs GROUP BY ALL),
vocab AS (
  SELECT lang, term, sum(n) AS n_term FROM counts WHERE term <> ''
  GROUP BY lang, term HAVING sum(docs) >= 3),
langs AS (
  SELECT lang, count(*) AS v, sum(n_term) AS n_lang FROM vocab GROUP BY lang),
sources AS (SELECT DISTINCT lang, source FROM counts),
dense AS (
  SELECT s.lang, s.source, k.term, k.n_term, coalesce(c.n, 0)::HUGEINT AS n
  FROM sources s JOIN vocab k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
sums AS (SELECT lang, source, sum(n) AS n_group FROM dense GROUP BY lang, source),
priced AS (
  SELECT d.lang, d.source, d.term, d.n,
         1 + (1000000000::HUGEINT * (d.n + 1)) // (n_group + v) AS p,
         1 + (1000000000::HUGEINT * (n_term + 1)) // (n_lang + v) AS q
  FROM dense d JOIN sums USING (lang, source) JOIN langs ON d.lang = langs.lang),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM priced a JOIN priced b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT
  FROM priced WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (
    PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

_INFILL_SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
numbers AS (
  SELECT doc_id, text, n,
         ('0x' || h[1:8])::BIGINT % (n + 1) AS r1, ('0x' || h[9:16])::BIGINT % (n + 1) AS r2,
         ('0x' || h[17:24])::BIGINT % 100 AS d3, ('0x' || h[25:32])::BIGINT % 100 AS d4
  FROM drawn),
formed AS (
  SELECT doc_id, text, n, least(r1, r2) AS a, greatest(r1, r2) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>')
                OR contains(text, '<M>') OR d3 >= 90 THEN 'plain'
              WHEN d4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers),
cut AS (
  SELECT *, substring(text, 1, a) AS pre, substring(text, a + 1, b - a) AS mid,
         substring(text, b + 1, n - b) AS suf
  FROM formed)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
"""

# No SQL form: 1 and 10 (binary containers, a compressor), 3, 6 and 12 (byte-pair merges are a
# sequential process per word), 7 (places of leftmost matches).
ORACLE_SQL: dict[str, str] = {
    "op11_source_divergence": _DIVERGENCE_SQL,
    "op13_fill_in_middle": _INFILL_SQL,
}
