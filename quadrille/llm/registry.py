"""The corpus operators' queries and SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quadrille.llm import bpe, decontamination, html_extraction, language_id, license_scan, media, near_dedup, pii, quality, substring_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        html_extraction.op1_html_extraction,
        decontamination.op2_decontamination,
        bpe.op3_bpe,
        substring_dedup.op4_substring_dedup,
        near_dedup.op5_near_dedup,
        pii.op6_pii,
        language_id.op7_language_id,
        media.op8_ogg_media,
        license_scan.op9_license_scan,
        quality.op10_quality,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontamination": decontamination.ORACLE,
        "op4_substring_dedup": substring_dedup.ORACLE,
        "op5_near_dedup": near_dedup.ORACLE,
        "op9_license_scan": license_scan.oracle(),
    }
