"""The corpus pipeline: every stage calls one operator of tallyproof.llm on all documents its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from tallyproof.llm import bpe, jaccard, mixing, pii, quality
from tallyproof.llm.staging import staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or a cutoff chosen on the labelled documents go."""
    judged = quality.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=docs.columns)
    return judged.filter("kept").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with similar shingle sets the one with the smallest doc_id stays (null last, then the first in the scan)."""
    numbered = staged(docs.withColumn("_row", F.monotonically_increasing_id()), "near-numbered")  # a later scan may number anew
    found = jaccard.near_duplicates(numbered, key="_row").select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group"))
    ranked = found.join(numbered.select("_row", "doc_id"), "_row")
    first = ranked.groupBy("_group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"].alias("_first"))
    gone = found.join(first, "_group").filter("_row <> _first").select("_row")
    return numbered.join(staged(gone, "near-copies"), "_row", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that disclose it are replaced by their kind."""
    return pii.sanitise(docs)


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix draws, each one once, since copies have just gone: a value wanted more often than it occurs stays below its share."""
    return mixing.mix(docs, mixing.TARGETS, mixing.POWERS).filter("kept").select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text as byte-level BPE ids and back."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("near copies", near_copies),
    ("personal data", personal_data),
    ("target mix", target_mix),
    ("tokens", tokens),
]

#: No stage with a trained cutoff, a grouping by iteration or a tokenizer can be put in SQL; tests/llm compares with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = staged(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
