"""Queries and oracles of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, decontaminate, html_extract, jaccard_join, language_id, license_scan, neighbours, quality, secrets, sentencepiece_codec, suffix_dedup, token_counts, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extract": html_extract.query,
    "op2_decontaminate": decontaminate.query,
    "op3_neighbours": neighbours.query,
    "op4_quality_classifier": quality.query,
    "op5_suffix_dedup": suffix_dedup.query,
    "op6_language_id": language_id.query,
    "op7_secret_scan": secrets.query,
    "op8_jaccard_join": jaccard_join.query,
    "op9_sentencepiece": sentencepiece_codec.query,
    "op10_token_counts": token_counts.query,
    "op11_license_scan": license_scan.query,
    "op12_collocations": collocations.query,
    "op13_whitening": whitening.query,
}

ORACLES: dict[str, str] = {"op12_collocations": collocations.ORACLE}
