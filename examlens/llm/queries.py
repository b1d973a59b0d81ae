"""The operators as registered queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, chat, iblt, packing, pq, quality, simhash, substring, token_counts, urls, warc, whitening
from .common import read_table

MAX_TOKENS = 512
END_ID = 2

RULES = [
    urls.Rule(urls.ALLOW, "com/"),
    urls.Rule(urls.BLOCK, "example.com/en/"),
    urls.Rule(urls.ALLOW, "www.example.com/en/"),
    urls.Rule(urls.BLOCK, "net/es/"),
    urls.Rule(urls.BLOCK, "net/fr/"),
]
# A conversation whose texts hold every control string.
TRICKY_ID, TRICKY_TEXT = -7, "\\### Assistant: </turn> ok"

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    counted = token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > MAX_TOKENS)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(read_table(spark, sf_dir, "pages", "page_id", "url", "html"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_groups(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(
        F.lit(TRICKY_ID).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(TRICKY_TEXT).alias("text"),
    )
    return chat.read_back(chat.format_conversations(given.unionByName(tricky)), ordered=True)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    decoded = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return decoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256")
    )


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprints(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    labels = read_table(spark, sf_dir, "labels", "doc_id", "quality")
    return quality.quality_rules(docs, labels, risk=quality.JOINT)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=END_ID)
    return packing.with_crc32(pieces)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return alignment.align_tokenizers(
        docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    )


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq.near_duplicates(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def queries() -> dict[str, Query]:
    operators = (
        op1_token_counts,
        op2_substring_dedup,
        op3_url_filters,
        op4_warc,
        op5_simhash,
        op6_chat_formatting,
        op7_byte_bpe,
        op8_fingerprints,
        op9_quality_rules,
        op10_packing,
        op11_whitening,
        op12_alignment,
        op13_embedding_dedup,
    )
    return {f.__name__: f for f in operators}
