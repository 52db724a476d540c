"""Queries and SQL of this subpackage, as __spark_entry__ registers them."""

from __future__ import annotations

from . import conversations, fingerprints, importance, joins, language, merkle, mixing, neardup, packing, suffixes, topk, toxicity, urls

QUERIES = {
    "op1_importance_resampling": importance.op1_importance_resampling,
    "op2_near_duplicates": neardup.op2_near_duplicates,
    "op3_impact_search": topk.op3_impact_search,
    "op4_order_minhash": fingerprints.op4_order_minhash,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_language": language.op6_language,
    "op7_suffix_repeats": suffixes.op7_suffix_repeats,
    "op8_url_templates": urls.op8_url_templates,
    "op9_pack_sequences": packing.op9_pack_sequences,
    "op10_mix_sources": mixing.op10_mix_sources,
    "op11_jaccard_join": joins.op11_jaccard_join,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_conversation_repair": conversations.op13_conversation_repair,
}

SQL = {
    "op3_impact_search": topk.OP3_SQL,
    "op10_mix_sources": mixing.OP10_SQL,
    "op11_jaccard_join": joins.OP11_SQL,
    "op12_merkle_manifest": merkle.OP12_SQL,
    "op13_conversation_repair": conversations.OP13_SQL,
}
