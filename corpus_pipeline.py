"""The corpus pipeline over `documents`: stages in order, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slidemesh.llm.bpe import round_trip, vocabulary
from slidemesh.llm.common import Scratch, table
from slidemesh.llm.exact_dedup import deduplicated
from slidemesh.llm.mixing import sampled
from slidemesh.llm.quality_qda import accepted
from slidemesh.llm.simhash_ball import near_deduplicated

ORACLE_SQL = None   # trained scores, fingerprints and seeded draws have no SQL form


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quadratic discriminant, learnt from the labels, accepts; empty texts are scored like any other."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of texts that are equal but for runs of white space."""
    return deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group connected at a similarity of 0.8 or more on shingles of five words."""
    return near_deduplicated(docs, 0.8, 5)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of half the tokens, with sources, languages and forms raked to tempered shares."""
    return sampled(docs, 0.5)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the SHA-256 of the bytes that the ids decode to."""
    path, pattern = vocabulary()
    out = round_trip(docs, path, pattern, keep=False)
    return out.select(F.col("id").alias("doc_id"), "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what a stage returns is a table below spark.checkpoint.dir for the next."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
