"""Queries and SQL of the training-data operators, as the entry module registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import exact_dedup, lm_scoring, mixing, neighbours, pieces, sharding, simhash, toxicity, url_filter, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_lm_scoring": lm_scoring.op2_lm_scoring,
        "op3_url_filter": url_filter.op3_url_filter,
        "op4_neighbours": neighbours.op4_neighbours,
        "op5_sharding": sharding.op5_sharding,
        "op6_mixing": mixing.op6_mixing,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_simhash": simhash.op8_simhash,
        "op9_warc": warc.op9_warc,
        "op10_sentencepiece": pieces.op10_sentencepiece,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.OP1_SQL,
        "op3_url_filter": url_filter.OP3_SQL,
        "op6_mixing": mixing.OP6_SQL,
        "op9_warc": warc.OP9_SQL,
    }
