"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnfold.llm import decontamination, jaccard_join, license_scan, mixing, neighbours, pii, quality, secret_scan, sharding, suffix_dedup

QueryFn = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, QueryFn]:
    return {
        "op1_quality": quality.op1_quality,
        "op2_neighbours": neighbours.op2_neighbours,
        "op3_personal_data": pii.op3_personal_data,
        "op4_rendezvous": sharding.op4_rendezvous,
        "op5_license": license_scan.op5_license,
        "op6_jaccard_join": jaccard_join.op6_jaccard_join,
        "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
        "op8_mix": mixing.op8_mix,
        "op9_decontamination": decontamination.op9_decontamination,
        "op10_secrets": secret_scan.op10_secrets,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_license": license_scan.oracle(), "op6_jaccard_join": jaccard_join.oracle(), "op7_suffix_dedup": suffix_dedup.oracle(), "op8_mix": mixing.oracle()}
