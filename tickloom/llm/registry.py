"""The queries of this subpackage by name, and the check SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import q_alignment, q_html, q_jaccard, q_lattice, q_mixing, q_packing, q_quality, q_search, q_secrets, q_toxicity, q_warc, q_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": q_jaccard.op1_ngram_jaccard_join,
    "op2_top_k_search": q_search.op2_top_k_search,
    "op3_quality_rules": q_quality.op3_quality_rules,
    "op4_html_extraction": q_html.op4_html_extraction,
    "op5_mix_sources": q_mixing.op5_mix_sources,
    "op6_license_scan": q_search.op6_license_scan,
    "op7_pack_sequences": q_packing.op7_pack_sequences,
    "op8_secret_scan": q_secrets.op8_secret_scan,
    "op9_warc_normalise": q_warc.op9_warc_normalise,
    "op10_toxicity": q_toxicity.op10_toxicity,
    "op11_align_tokenizers": q_alignment.op11_align_tokenizers,
    "op12_lattice_score": q_lattice.op12_lattice_score,
    "op13_whiten": q_whitening.op13_whiten,
}

CHECKS: dict[str, str] = {
    "op1_ngram_jaccard_join": q_jaccard.CHECK,
    "op3_quality_rules": q_quality.CHECK,
    "op9_warc_normalise": q_warc.CHECK,
}
