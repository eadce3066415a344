"""Corpus pipeline: documents to token ids in five stages, each over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trailcast.llm import bpe, common, language_id, mixing, order_minhash, substring_dedup, tokenizer_files

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null texts and texts without a letter go."""
    common.drop_tables(spark)
    return language_id.keep_identified(docs.select(COLUMNS)).select(COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest doc_id."""
    common.drop_tables(spark)
    return order_minhash.classes(docs.select(COLUMNS)).where("kept").select(COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of repeated windows; a text may become empty."""
    common.drop_tables(spark)
    cleaned = substring_dedup.remove_repeats(docs.select(COLUMNS))
    changed = F.col("n_removed") > 0
    return cleaned.select(
        "doc_id", F.col("kept_text").alias("text"), "lang", "source",
        F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture over sources: tempered until a source's tokens come 1.25 times, as many tokens in all as before."""
    common.drop_tables(spark)
    return mixing.mix(docs.select(COLUMNS), mixing.Target(max_repeats=1.25)).select(COLUMNS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, their number, and the digest of the text that they decode to."""
    common.drop_tables(spark)
    spec, pattern = tokenizer_files.byte_bpe()
    return bpe.tokenized(docs.select(COLUMNS), spec, pattern).select(
        "doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256")


STAGES = [
    ("language ID", language_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("mixing", mixing_stage),
    ("BPE", bpe_stage),
]

#: Edit-distance classes and BPE are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's table goes when the next one is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        path = common.new_path(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last is not None:
            common.drop_path(spark, last)
        last = path
    return docs
