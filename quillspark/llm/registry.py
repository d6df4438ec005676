"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import decontamination, fingerprints, language, mixing, near_duplicates, pitman_yor, secrets, sharding, suffix_repeats, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_sharding": sharding.op1_sharding,
        "op2_language": language.op2_language,
        "op3_secrets": secrets.op3_secrets,
        "op4_fingerprints": fingerprints.op4_fingerprints,
        "op5_near_duplicates": near_duplicates.op5_near_duplicates,
        "op6_mixing": mixing.op6_mixing,
        "op7_suffix_repeats": suffix_repeats.op7_suffix_repeats,
        "op8_decontamination": decontamination.op8_decontamination,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_pitman_yor": pitman_yor.op10_pitman_yor,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_near_duplicates": near_duplicates.OP5_SQL,
        "op6_mixing": mixing.OP6_SQL,
        "op7_suffix_repeats": suffix_repeats.OP7_SQL,
        "op8_decontamination": decontamination.OP8_SQL,
    }
