"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

The stages keep the columns of documents until the last, which returns one row of token ids per document.
Each stage judges all that its predecessor kept.

Nulls, ties and the like: a null or empty text goes in the first stage; rows without id are treated like others and stand last where the least id counts; of
rows that repeat an id and text, or a class of near copies, one stays; texts of any length are read whole; an empty table gives an empty table; further
columns, whatever they are called, stay as they are until the last stage, which leaves them out.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusstat.llm import blocks, bpe, decontaminate, minhash, quality, secret_scan

#: The vocabulary's file.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays."""
    return minhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of benchmark items are cut out; documents that consist of them for the most part go."""
    out = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mask."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document: its token ids."""
    ids = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_dedup), ("benchmark decontamination", benchmark_decontamination), ("secret scans", secret_redaction), ("byte-level BPE", encoding)]

#: SQL can't express compression ratios, signatures, automata, forests or merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = blocks.written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
