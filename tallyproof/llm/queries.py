"""Registered queries of this subpackage and, where SQL can express them, the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyproof.llm import alignment, bpe, classifier, epsilon, jaccard, licenses, mixing, negatives, pii, planes, quality, repeats, sharding
from tallyproof.llm.staging import folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as byte-level BPE ids and back."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(bpe.encode(_documents(spark, sf_dir), ranks, public_tokenizers.PATTERN), ranks)


@query
def op2_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's ids written to plane files in doc_id order, and read back."""
    docs, path = _documents(spark, sf_dir), folder(spark, "token-planes")
    planes.write_store(planes.encode_words(docs, public_tokenizers.path("word_bpe_49k.json"), end=2), docs.select("doc_id"), path)
    return planes.read_store(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices of every text."""
    return licenses.scan(_documents(spark, sf_dir)).drop("spans")


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the quality rules on every text, cutoffs chosen on the labelled documents."""
    judged = quality.judge(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=["doc_id"])
    return judged.select(F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's raked weight and how often it is drawn."""
    mixed = mixing.mix(_documents(spark, sf_dir).select("doc_id", "text", "lang", "source"), mixing.TARGETS, mixing.POWERS)
    return mixed.select(F.col("row.doc_id").alias("doc_id"), "source", "lang", "topic", "n_tokens", "weight", "probability", "miss", "copies", "kept")


@query
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every text, learnt from positives and unlabelled text."""
    return classifier.score(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document among those whose shingle sets are similar."""
    return jaccard.near_duplicates(_documents(spark, sf_dir)).drop("row")


@query
def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms of every text."""
    return pii.report(pii.spans(_documents(spark, sf_dir)))


@query
def op8_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of near-equal vectors."""
    return epsilon.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query
def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every text that repeat a string of an earlier document."""
    return repeats.remove_repeats(_documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op13_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written to one of 8 shards by its doc_id, with its slot there, and its shard if there were 9."""
    docs, path = _documents(spark, sf_dir).select("doc_id", "text"), folder(spark, "shards")
    sharding.write(docs, path, 8, "doc_id")
    text = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    placed = sharding.slots(spark, path, sharding.store_schema(docs))
    return placed.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col(sharding.SHARD).alias("shard"),
        "slot",
        sharding.shard_of(F.col("doc_id"), 9).alias("grown_shard"),
    )


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, for each of its five nearest of the same label."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


ORACLES["op11_hard_negatives"] = """
WITH given AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
pairs AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, o.r AS r, o.vec_id, a.label = o.label AS same, list_inner_product(a.v, o.v)::BIGINT AS score
  FROM given a JOIN given o ON a.r <> o.r AND len(a.v) = len(o.v)
  WHERE a.vec_id % 100 = 0
),
positive AS (
  SELECT ar, anchor_id, r AS pr, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id NULLS LAST, r) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.ar, p.pr ORDER BY n.score DESC, n.vec_id NULLS LAST, n.r) AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positive p JOIN pairs n ON n.ar = p.ar AND NOT n.same
WHERE 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""


@query
def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens of two tokenizers in every text."""
    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.report(alignment.align_corpus(_documents(spark, sf_dir), *files), *files)
