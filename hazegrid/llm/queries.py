"""The registered queries of the corpus operators, with their production parameters, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, jpeg, langid, line_dedup, mih, mixing, phrases, quality, simhash, token_counts, turns, url_rules, warc
from .common import table


def op1_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mih.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, sample_rows=4096)
    return found.withColumnRenamed("id", "vec_id")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.removed_lines(table(spark, sf_dir, "documents"), threshold=0.8, min_words=1)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), host_col="source", path_col="lang")


def op5_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.store_documents(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), power=0.8, iterations=12, seed=11)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))), per_lang=2000)
    out = langid.identify(docs, model)
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.array_sort(F.map_keys("langs")).alias("langs"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derive(warc.responses(table(spark, sf_dir, "pages")))
    return made.select(made.page.alias("page_id"), "warc_type", "record_id", "refers_to", "target_uri", "source_payload_digest", "block_digest", "content_length", "block")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


SITE_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: Hosts and words that spam pages carry, as patterns.
PATTERNS = [("^casino^", "block"), ("^cheap^pills^", "block"), ("^spam^farm^", "block"), ("^viagra^", "block")]


def op11_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(SITE_RULES + PATTERNS, "rule string, action string")
    out = url_rules.judge(table(spark, sf_dir, "pages"), rules)
    return out.select("page_id", "host", "path", F.when(F.col("site"), F.col("rule")).alias("rule"), "verdict", F.when(~F.col("site"), F.col("rule")).alias("pattern"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.digests(turns.segments(turns.damaged(table(spark, sf_dir, "conversations")), copies_col="copies"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), least=100, longest=5, top=2000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_multi_index": op1_multi_index,
    "op2_line_dedup": op2_line_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_quality": op4_quality,
    "op5_progressive_jpeg": op5_progressive_jpeg,
    "op6_mixing": op6_mixing,
    "op7_simhash": op7_simhash,
    "op8_language": op8_language,
    "op9_warc": op9_warc,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_url_rules": op11_url_rules,
    "op12_turn_repair": op12_turn_repair,
    "op13_collocations": op13_collocations,
}

ORACLES: dict[str, str] = {
    "op2_line_dedup": line_dedup.oracle(0.8, 1),
    "op6_mixing": mixing.oracle(0.8, 12, 11),
    "op9_warc": warc.oracle(),
    "op11_url_rules": url_rules.oracle(SITE_RULES + PATTERNS),
    "op12_turn_repair": turns.oracle(),
    "op13_collocations": phrases.oracle(100, 5, 2000),
}
