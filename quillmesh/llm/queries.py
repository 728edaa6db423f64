"""The queries of this subpackage and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from . import centroid_clustering, chat_parts, extendible_sharding, impact_topk, media_chunks, paragraph_dedup, pfair_mixing, pii_bootstrap, piece_fst, simhash_dedup, source_divergence, suffix_dedup, toxicity_grammar

QUERIES = {
    "op3_paragraph_dedup": paragraph_dedup.op3_paragraph_dedup,
    "op7_media_chunks": media_chunks.op7_media_chunks,
    "op5_pfair_mixing": pfair_mixing.op5_pfair_mixing,
    "op2_pii_bootstrap": pii_bootstrap.op2_pii_bootstrap,
    "op1_toxicity_grammar": toxicity_grammar.op1_toxicity_grammar,
    "op9_piece_fst": piece_fst.op9_piece_fst,
    "op4_impact_topk": impact_topk.op4_impact_topk,
    "op8_simhash_dedup": simhash_dedup.op8_simhash_dedup,
    "op6_chat_parts": chat_parts.op6_chat_parts,
    "op10_extendible_sharding": extendible_sharding.op10_extendible_sharding,
    "op11_source_divergence": source_divergence.op11_source_divergence,
    "op12_suffix_dedup": suffix_dedup.op12_suffix_dedup,
    "op13_centroid_clustering": centroid_clustering.op13_centroid_clustering,
}

ORACLES = {
    "op4_impact_topk": impact_topk.SQL,
    "op6_chat_parts": chat_parts.SQL,
    "op10_extendible_sharding": extendible_sharding.SQL,
    "op11_source_divergence": source_divergence.SQL,
    "op13_centroid_clustering": centroid_clustering.SQL,
}
