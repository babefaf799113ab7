"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bpe, html_extract, media, minhash, mixing, oracles, quality_rules, suffix_dedup, toxicity, warc, weak_quality


def mix_targets(spark, sf_dir: str):
    """The part of op1's result that SQL can express: sizes and targets (to three decimals)."""
    return mixing.query(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def media_payloads(spark, sf_dir: str):
    """The part of op4's result that SQL can express: payloads as they are read back."""
    return media.query(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def quality_counts(spark, sf_dir: str):
    """The part of op6's result that SQL can express: the base counts."""
    return quality_rules.query(spark, sf_dir).drop("distance2", "kept")


def queries() -> dict:
    """The query of each operator, and parts of some that have SQL."""
    return {
        "op1_mixing": mixing.query,
        "op2_bpe": bpe.query,
        "op3_weak_quality": weak_quality.query,
        "op4_media": media.query,
        "op5_warc": warc.query,
        "op6_quality_rules": quality_rules.query,
        "op7_suffix_dedup": suffix_dedup.query,
        "op8_minhash": minhash.query,
        "op9_html_extract": html_extract.query,
        "op10_toxicity": toxicity.query,
        "mix_targets": mix_targets,
        "media_payloads": media_payloads,
        "quality_counts": quality_counts,
    }


def oracle_sql() -> dict[str, str]:
    """The others need estimates, merges or models that SQL does not have; tests hold them against brute force."""
    return {"op5_warc": oracles.WARC, "op7_suffix_dedup": oracles.SUFFIX, "op8_minhash": oracles.MINHASH, "mix_targets": oracles.MIX, "media_payloads": oracles.PAYLOADS, "quality_counts": oracles.COUNTS}
