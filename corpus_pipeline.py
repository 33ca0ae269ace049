"""Corpus pipeline: quality, line dedup, near-duplicate documents, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs.  All stages but the
last return the columns of ``documents`` as they came in.

Defined cases: documents with null or empty text pass the filters (they match
nothing) unless the classifier rejects them, and get no tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normlens.llm import byte_bpe, decontaminate, line_dedup, minhash_dedup, quality
from normlens.llm.common import checked_broadcast, materialize, read_table


def _without(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """``docs`` without the ids of a stored list (broadcast only when it is small enough)."""
    ids = materialize(ids.select(F.col("id").alias("doc_id")), name)
    return docs.join(checked_broadcast(ids, ids.count(), 2_000_000), "doc_id", "left_anti").select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    scores = quality.quality_scores(docs, "doc_id", "text", "source", "lang",
                                    read_table(spark, sf_dir, "labels"), "doc_id", "quality")
    return _without(docs, scores.where("NOT keep"), "rejected")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, but for their first occurrence; a document left without any text goes too."""
    out = line_dedup.cleaned(docs, "doc_id", "text", least_chars=1)
    cut = F.col(out.columns[-1]) > 0
    out = out.where(~cut | (F.trim("text") != ""))
    return out.withColumn("n_chars", F.when(cut, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, similarity of 0.8 or more)."""
    return _without(docs, minhash_dedup.near_duplicates(docs, "doc_id", "text").where("NOT kept"), "copies")


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover a benchmark item by 0.6 or more go."""
    bench = read_table(spark, sf_dir, "benchmark")
    hits = decontaminate.contaminated(decontaminate.matches(docs, "doc_id", "text", bench, "item_id", "text"))
    return _without(docs, hits.withColumnRenamed("doc_id", "id"), "leaks")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the bytes they decode to."""
    out = byte_bpe.round_trip_digests(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                      public_tokenizers.PATTERN, with_ids=True)
    return out.withColumnRenamed("id", "doc_id")


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("near_duplicates", near_duplicate_stage),
          ("decontamination", benchmark_stage), ("tokens", token_stage)]

#: SQL cannot express the classifier, the tiling or the merges; tests/llm/ holds brute-force versions of the operators.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written as Parquet and reread."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
