"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from quireflow.llm import archives, bpe, jaccard, pii, preferences, quality, repetition, store, suffixes, winnow

QUERIES = {
    "op1_repetition": repetition.op1_repetition,
    "op2_pu_quality": quality.op2_pu_quality,
    "op3_preferences": preferences.op3_preferences,
    "op4_wacz": archives.op4_wacz,
    "op5_bpe": bpe.op5_bpe,
    "op6_pii": pii.op6_pii,
    "op7_token_store": store.op7_token_store,
    "op8_suffix_dedup": suffixes.op8_suffix_dedup,
    "op9_winnowing": winnow.op9_winnowing,
    "op10_jaccard_join": jaccard.op10_jaccard_join,
}
ORACLES = {
    "op1_repetition": repetition.SQL,
    "op3_preferences": preferences.SQL,
    "op4_wacz": archives.SQL,
    "op8_suffix_dedup": suffixes.SQL,
    "op9_winnowing": winnow.SQL,
    "op10_jaccard_join": jaccard.SQL,
}
