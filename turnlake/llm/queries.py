"""Queries of the subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm import bpe, html_text, mixing, perplexity, simhash, substring, token_count, topk, toxicity, urls
from turnlake.llm.common import cleaned


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer(name: str) -> bytes:
    """A tokenizer's file, read by the driver: a few MB at most, and the same at every input size."""
    return Path(public_tokenizers.path(name)).read_bytes()


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(read(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"), urls.RULES)


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.judge(read(spark, sf_dir, "documents"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per run of words that goes: doc_id, start, end, n_words, component_id, kept_id."""
    return substring.repeats(read(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), width=3, radius=2)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").fillna(mixing.NONE, ["source", "lang"])
    return mixing.mix(docs).select("doc_id", "source", "lang", "topic", "n_tokens", "probability", "kept")


QUERIES = {f.__name__: cleaned(f) for f in (op1_byte_bpe, op2_url_filter, op3_top_k, op4_main_text, op5_quality, op6_repeats, op7_toxicity, op8_simhash, op9_mixing, op10_token_counts)}
SQL: dict[str, str] = {"op3_top_k": topk.SQL, "op9_mixing": mixing.mix_sql()}
