"""Queries opN_<name> and pipeline, and their SQL."""

from __future__ import annotations

import corpus_pipeline
from tessera.llm import decontamination, html_text, packing, pii, quality_rules, secret_scan, sharding, simhash, suffix_dedup, toxicity

_QUERIES = {
    "op1_quality_rules": quality_rules.op1_query,
    "op2_simhash": simhash.op2_query,
    "op3_toxicity": toxicity.op3_query,
    "op4_secret_scan": secret_scan.op4_query,
    "op5_decontamination": decontamination.op5_query,
    "op6_sharding": sharding.op6_query,
    "op7_suffix_dedup": suffix_dedup.op7_query,
    "op8_pii": pii.op8_query,
    "op9_packing": packing.op9_query,
    "op10_html_text": html_text.op10_query,
    "pipeline": corpus_pipeline.run,
}

#: The other operators learn, decode, hash by functions that SQL lacks, or pack in order; tests hold them against plain versions.
_ORACLES: dict[str, str] = {"op1_quality_rules": quality_rules.ORACLE_SQL}


def queries():
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
