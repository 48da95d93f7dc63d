"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from tarifa.llm import chat, divergence, exact, jaccard, mixing, packing, pii, quality, rules, search, substrings, tokens, toxicity

QUERIES = {
    "op1_mixing": mixing.query,
    "op2_quality_classifier": quality.query,
    "op3_ngram_jaccard": jaccard.query,
    "op4_pii": pii.query,
    "op5_exact_dedup": exact.query,
    "op6_chat_formatting": chat.query,
    "op7_suffix_dedup": substrings.query,
    "op8_token_counts": tokens.query,
    "op9_quality_rules": rules.query,
    "op10_packing": packing.query,
    "op11_lexical_search": search.query,
    "op12_toxicity": toxicity.query,
    "op13_source_divergence": divergence.query,
}
ORACLE_SQL = {"op1_mixing": mixing.ORACLE, "op5_exact_dedup": exact.ORACLE, "op6_chat_formatting": chat.ORACLE, "op9_quality_rules": rules.ORACLE, "op11_lexical_search": search.ORACLE, "op13_source_divergence": divergence.ORACLE}
