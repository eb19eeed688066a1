"""The registered query of each operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import jaccard, mixing, neighbours, pieces, quality, secrets, sharding, suffixes, tokens, urls

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_token_counts": tokens.op1_token_counts,
        "op2_gumbel_pieces": pieces.op2_gumbel_pieces,
        "op3_url_rules": urls.op3_url_rules,
        "op4_secret_spans": secrets.op4_secret_spans,
        "op5_poisson_mix": mixing.op5_poisson_mix,
        "op6_count_vector_join": jaccard.op6_count_vector_join,
        "op7_learned_partitions": neighbours.op7_learned_partitions,
        "op8_suffix_dedup": suffixes.op8_suffix_dedup,
        "op9_feistel_shards": sharding.op9_feistel_shards,
        "op10_repetition_coverage": quality.op10_repetition_coverage,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_poisson_mix": mixing.SQL,
        "op6_count_vector_join": jaccard.SQL,
        "op8_suffix_dedup": suffixes.SQL,
        "op9_feistel_shards": sharding.SQL,
        "op10_repetition_coverage": quality.SQL,
    }
