"""A training corpus from raw documents: the stages of the pipeline, in order.

Each stage works on what the one before has kept, and all but the last return the columns of
``documents``. Rows with a null or empty text, or one without letters, have no language and end
in the first stage. Stages by themselves keep such rows; repeated rows stay as they are, but for
copies with another id, of which the smallest id stays; very long texts are worked on whole; an
empty table stays empty. Further columns pass through, whatever their names are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions.lineage import shared_folder
from corpusflow.llm import bpe, decontaminate, language, near, pii, queries
from corpusflow.llm.frames import fresh, without
from corpusflow.session import ship_package

# Near duplicates of the pipeline: five-word shingles, similarity of 0.8 or more.
WIDTH, PERCENT = 5, 80


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; the dictionaries come from the same documents."""
    ship_package(spark)
    content = language.fit(docs.where(~language.held_out()))
    predicted, score, rejected = fresh(docs, "pred", "score", "rejected")
    named = language.identify(docs, content, "text", predicted, score, rejected)
    return named.where(~F.col(rejected)).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates."""
    ship_package(spark)
    groups = near.near_duplicates(docs.select("doc_id", "text"), width=WIDTH, percent=PERCENT)
    gone = groups.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship_package(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    [leaks] = fresh(docs, "leaks")
    checked = decontaminate.find_leaks(docs, items, leaks=leaks)
    return checked.where(F.size(leaks) == 0).select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data; ``n_chars`` follows the new text."""
    [found] = fresh(docs, "pii")
    masked = pii.pseudonymize(docs, queries.PII_KEY, found=found)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with a digest of the text that they decode to.

    Columns of the names ``ids``, ``n_tokens`` and ``decoded_sha256`` are replaced.
    """
    ship_package(spark)
    path = queries.tokenizer_file(queries.ENCODE_FILE)
    ids, decoded = fresh(docs, "ids", "decoded")
    coded = bpe.encode_and_decode(docs, path, ids=ids, decoded=decoded)
    return coded.select(
        *without(docs, ["ids", "n_tokens", "decoded_sha256"]),
        F.col(ids).alias("ids"),
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(decoded, 256).alias("decoded_sha256"),
    )


STAGES = [
    ("keep_known_languages", keep_known_languages),
    ("keep_one_of_each_group", keep_one_of_each_group),
    ("drop_benchmark_leaks", drop_benchmark_leaks),
    ("mask_personal_data", mask_personal_data),
    ("encode_texts", encode_texts),
]

# The language stage compresses and the last one merges byte pairs: no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each reading what the one before has written."""
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{number}-{name}")
        docs = spark.read.parquet(f"{base}/{number}-{name}")
    return docs
