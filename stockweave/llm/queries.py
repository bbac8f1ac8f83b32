"""Queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from stockweave.llm import license_scan, media, mixing, ngram_join, pii, quality_rules, sentencepiece_lattice, token_store, toxicity, warc

QUERIES = {
    "op1_sentencepiece": sentencepiece_lattice.op1_sentencepiece,
    "op2_pii_semi_markov": pii.op2_pii_semi_markov,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_token_store": token_store.op4_token_store,
    "op5_license_scan": license_scan.op5_license_scan,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_warc_dictionary": warc.op8_warc_dictionary,
    "op9_media_columns": media.op9_media_columns,
    "op10_mix_sources": mixing.op10_mix_sources,
}

ORACLES = {
    "op3_ngram_join": ngram_join.ORACLE,
    "op5_license_scan": license_scan.ORACLE,
    "op6_quality_rules": quality_rules.ORACLE,
    "op8_warc_dictionary": warc.ORACLE,
    "op10_mix_sources": mixing.ORACLE,
}
