"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from convarchive.llm import chat_formatting, decontamination, hard_negatives, line_dedup, lm_scoring, merkle, packing, pii, quality_rules, simhash, substring_dedup, toxicity, url_filters

QUERIES = {
    "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_lm_scoring": lm_scoring.op4_lm_scoring,
    "op5_pii_surrogates": pii.op5_pii_surrogates,
    "op6_chat_formatting": chat_formatting.op6_chat_formatting,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_url_filters": url_filters.op9_url_filters,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_substring_dedup": substring_dedup.op11_substring_dedup,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLES = {
    "op3_quality_rules": quality_rules.ORACLE,
    "op6_chat_formatting": chat_formatting.ORACLE,
    "op7_line_dedup": line_dedup.ORACLE,
    "op8_decontamination": decontamination.ORACLE,
    "op9_url_filters": url_filters.ORACLE,
    "op11_substring_dedup": substring_dedup.ORACLE,
    "op12_merkle_manifest": merkle.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
