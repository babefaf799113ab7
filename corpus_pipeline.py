"""Corpus pipeline: quality rules, near-duplicates, repeated passages, mixing, BPE; each stage is written and read again.

Defined results: null and empty texts fail the quality rules; rows of one id are told apart by their texts in every
stage; of repeated rows one is left after the second stage; ties are as the operators state; very long texts go through
whole; an empty table gives an empty result; other columns, of any name, are kept up to the fourth stage. The last
stage returns doc_id and ids alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelag.llm import bpe, minhash, mixing, quality_rules, suffix_dedup
from tidelag.llm.common import stored

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("minhash", minhash.stage),
    ("suffix_dedup", suffix_dedup.stage),
    ("mixing", mixing.stage),
    ("bpe", bpe.stage),
]

#: SQL can't express the estimates, the near-duplicates over whole tables, the hash order or the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = docs if k == len(STAGES) - 1 else stored(docs, f"pipeline-{name}")
    return docs
