"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, html_main, near_dedup, nearest, packing, phrases, pii, quality, quality_rules, secrets, suffix_dedup, token_output, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": decontamination.op1_decontamination,
        "op2_token_output": token_output.op2_token_output,
        "op3_packing": packing.op3_packing,
        "op4_quality": quality.op4_quality,
        "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
        "op6_pii": pii.op6_pii,
        "op7_nearest": nearest.op7_nearest,
        "op8_near_dedup": near_dedup.op8_near_dedup,
        "op9_html": html_main.op9_html,
        "op10_secret_scan": secrets.op10_secret_scan,
        "op11_quality_rules": quality_rules.op11_quality_rules,
        "op12_collocations": phrases.op12_collocations,
        "op13_whitening": whitening.op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": decontamination.ORACLE_SQL,
        "op5_suffix_dedup": suffix_dedup.ORACLE_SQL,
        "op7_nearest": nearest.ORACLE_SQL,
        "op8_near_dedup": near_dedup.ORACLE_SQL,
        "op9_html": html_main.ORACLE_SQL,
        "op11_quality_rules": quality_rules.ORACLE_SQL,
        "op12_collocations": phrases.ORACLE_SQL,
    }
