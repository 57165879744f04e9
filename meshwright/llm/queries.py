"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meshwright.llm import ctw, decontaminate, divergence, langid, licenses, packing, quality, simhash, substring, toxicity, urls, warc, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_substring_dedup": substring.op2_substring_dedup,
        "op3_language_id": langid.op3_language_id,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_quality_rules": quality.op5_quality_rules,
        "op6_ctw_score": ctw.op6_ctw_score,
        "op7_simhash_near_dedup": simhash.op7_simhash_near_dedup,
        "op8_warc_derivatives": warc.op8_warc_derivatives,
        "op9_url_filter": urls.op9_url_filter,
        "op10_length_buckets": packing.op10_length_buckets,
        "op11_source_divergence": divergence.op11_source_divergence,
        "op12_license_scan": licenses.op12_license_scan,
        "op13_embedding_whitening": whitening.op13_embedding_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": decontaminate.OP1_SQL, "op2_substring_dedup": substring.OP2_SQL, "op5_quality_rules": quality.OP5_SQL, "op8_warc_derivatives": warc.OP8_SQL,
        "op11_source_divergence": divergence.OP11_SQL,
    }
