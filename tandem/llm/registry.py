"""The subpackage's queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tandem.llm import byte_bpe, decontaminate, licenses, media, near_dups, suffix_dedup, token_counts, toxicity, url_filter, word_windows


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_licenses": licenses.query,
        "op2_decontaminate": decontaminate.query,
        "op3_suffix_dedup": suffix_dedup.query,
        "op4_token_counts": token_counts.query,
        "op5_near_dups": near_dups.query,
        "op6_media": media.query,
        "op7_toxicity": toxicity.query,
        "op8_byte_bpe": byte_bpe.query,
        "op9_word_windows": word_windows.query,
        "op10_url_filter": url_filter.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_licenses": licenses.ORACLE_SQL,
        "op2_decontaminate": decontaminate.ORACLE_SQL,
        "op3_suffix_dedup": suffix_dedup.ORACLE_SQL,
        "op9_word_windows": word_windows.ORACLE_SQL,
        "op10_url_filter": url_filter.ORACLE_SQL,
    }
