"""Queries of the corpus operators, one a operator, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, licenses, mixing, neardup, pii, quality, tokencount, topk, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """opN_<name> -> callable(spark, sf_dir)."""
    return {
        "op1_byte_bpe": bpe.op1_byte_bpe,
        "op2_quality_ratio": quality.op2_quality_ratio,
        "op3_token_counts": tokencount.op3_token_counts,
        "op4_temperature_mix": mixing.op4_temperature_mix,
        "op5_warc_round_trip": warc.op5_warc_round_trip,
        "op6_topk_tiles": topk.op6_topk_tiles,
        "op7_disclosure": pii.op7_disclosure,
        "op8_license_digests": licenses.op8_license_digests,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_minhash_forest": neardup.op10_minhash_forest,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    return {
        "op4_temperature_mix": mixing.OP4_SQL,
        "op5_warc_round_trip": warc.OP5_SQL,
        "op6_topk_tiles": topk.OP6_SQL,
        "op8_license_digests": licenses.OP8_SQL,
    }
