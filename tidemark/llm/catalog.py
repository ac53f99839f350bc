"""The registered queries of this subpackage and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bm25, html_extract, jaccard_join, language_id, mixing, packing, secret_scan, substring_dedup, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bm25_topk": bm25.query,
        "op2_jaccard_join": jaccard_join.query,
        "op3_source_mixing": mixing.query,
        "op4_prefix_forest": ann.query,
        "op5_substring_dedup": substring_dedup.query,
        "op6_url_filter": url_filter.query,
        "op7_secret_scan": secret_scan.query,
        "op8_html_text": html_extract.query,
        "op9_language_id": language_id.query,
        "op10_packing": packing.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_jaccard_join": jaccard_join.SQL,
        "op5_substring_dedup": substring_dedup.SQL,
        "op6_url_filter": url_filter.SQL,
        "op7_secret_scan": secret_scan.SQL,
    }
