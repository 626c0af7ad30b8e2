"""A corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

In every stage a null or empty text is handled: language identification drops it, as it has no letters, and the others keep
what comes to them. Rows without an id stay in line and near-duplicate stages and are never sampled; rows that repeat an id are
treated alike. Ties go to the earlier line and the smaller id. Texts of any length are read whole, empty tables give empty
ones, and columns besides those of documents are kept, whatever their names.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazegrid.llm import byte_bpe, langid, line_dedup, mixing, simhash
from hazegrid.llm.common import drop_table, shared_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without letters go. `lang` becomes the predicted language."""
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))), per_lang=2000)
    return langid.filter_documents(docs, model)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat or nearly repeat an earlier line of any document go; blank ones stay, and those of fewer than five words and 20 bytes, mostly ends of wrapped lines."""
    out = line_dedup.dedup_lines(docs, threshold=0.8, min_words=1, short=(5, 20))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (Jaccard 0.8 on five-word shingles) stays, the one with the smallest id."""
    return simhash.keep_one(docs, words=5, threshold=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow the tempered source, language and topic targets."""
    return mixing.sample(docs, power=0.8, iterations=12, seed=11)


def byte_bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document, with digests of the ids and of the decoded bytes."""
    return byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("simhash_dedup", simhash_dedup),
    ("mix_sources", mix_sources),
    ("byte_bpe", byte_bpe_encode),
]

#: The first stage, among others, is not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written to the shared folder and read from there; one that the next has read is deleted."""
    at = f"{shared_dir(spark)}/corpus_pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        out = f"{at}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            drop_table(spark, before)
        before = out
    return docs
