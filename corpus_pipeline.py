"""The corpus pipeline: toxicity, near-duplicates, repeated passages, mixing, tokens; every stage is written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm import bpe, mixing, similar, substring, toxicity
from turnlake.llm.common import cleaned, discard, free_name, scratch
from turnlake.llm.queries import read, tokenizer


@cleaned
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't hold for toxic; it learns from the labels of training rows in docs."""
    return toxicity.reject(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


@cleaned
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: SimHash fingerprints at most 2 bits apart, or a similarity of 0.8 or more."""
    return similar.deduplicate(docs, radius=2)


@cleaned
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand elsewhere; n_chars is counted anew, texts that had nothing else go."""
    cut = substring.remove(docs, substring.repeats(docs))
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


@cleaned
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens are distributed over sources, languages and topics as targeted; columns of docs stay as they are."""
    own = {c: free_name(docs, f"own_{c}") for c in docs.columns if c in ("topic", "n_tokens", "probability", "kept")}
    return mixing.mix(docs.withColumnsRenamed(own)).filter("kept").select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


@cleaned
def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of whole texts, with their number and the MD5 of the text that the ids are decoded to.

    Executors' heaps are as large as the stages before made them, so workers keep small caches.
    """
    out = bpe.encode(docs.select("doc_id", "lang", "source", "text"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded_col="decoded", kept=(20_000, 70_000, 70_000))
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.md5("decoded").alias("decoded_md5"))



STAGES = [("toxicity", reject_toxic), ("simhash near-dedup", drop_near_duplicates), ("substring dedup", cut_repeats), ("mixing", mix_sources), ("byte-level bpe", encode_tokens)]

#: The first stage, a trained classifier, has no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    last = None
    for name, stage in STAGES:
        docs = scratch(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        if last is not None:
            discard(last)
        last = docs
    return docs
