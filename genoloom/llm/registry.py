"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from genoloom.llm import bpe, decontam, jaccard, oracles, quality, rules, secrets, sharding, sufdedup, token_counts, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_decontamination": decontam.op2_decontamination,
    "op3_quality": quality.op3_quality,
    "op4_suffix_dedup": sufdedup.op4_suffix_dedup,
    "op5_jaccard_join": jaccard.op5_jaccard_join,
    "op6_bpe": bpe.op6_bpe,
    "op7_warc": warc.op7_warc,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_sharding": sharding.op9_sharding,
    "op10_quality_rules": rules.op10_quality_rules,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {**oracles.ORACLES, **({} if corpus_pipeline.ORACLE_SQL is None else {"pipeline": corpus_pipeline.ORACLE_SQL})}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
