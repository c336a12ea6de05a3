"""The queries opN_<name> of this subpackage and their SQL."""

from __future__ import annotations

from trendloom.llm import embedding_dedup, exact_dedup, hard_negatives, html_extract, langid, line_dedup, merkle, mixing, packing, quality, simhash, tokens, toxicity

QUERIES = {
    "op1_exact_dedup": exact_dedup.query,
    "op2_embedding_dedup": embedding_dedup.query,
    "op3_language": langid.query,
    "op4_packing": packing.query,
    "op5_simhash": simhash.query,
    "op6_token_counts": tokens.query,
    "op7_mixing": mixing.query,
    "op8_line_dedup": line_dedup.query,
    "op9_quality": quality.query,
    "op10_toxicity": toxicity.query,
    "op11_manifest": merkle.query,
    "op12_html_extract": html_extract.query,
    "op13_hard_negatives": hard_negatives.query,
}

ORACLE_SQL = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op2_embedding_dedup": embedding_dedup.SQL,
    "op7_mixing": mixing.SQL,
    "op8_line_dedup": line_dedup.SQL,
    "op11_manifest": merkle.SQL,
    "op13_hard_negatives": hard_negatives.SQL,
}
