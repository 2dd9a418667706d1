"""The registered queries of the training-data operators and, where SQL can express them, their oracle."""

from __future__ import annotations

from . import bpe, exact_dedup, html_text, log_bilinear, manifest, mixing, quality, resampling, sharding, shingle_join, substring_dedup, topk, warc

QUERIES = {
    "op1_pivot_top_k": topk.query,
    "op2_suffix_automaton_dedup": substring_dedup.query,
    "op3_digest_index_dedup": exact_dedup.query,
    "op4_feistel_sharding": sharding.query,
    "op5_byte_bpe": bpe.query,
    "op6_salvaging_warc": warc.query,
    "op7_fair_queue_mix": mixing.query,
    "op8_site_bayes_quality": quality.query,
    "op9_signature_tree_join": shingle_join.query,
    "op10_template_free_text": html_text.query,
    "op11_importance_resampling": resampling.query,
    "op12_log_bilinear_scores": log_bilinear.query,
    "op13_merkle_manifest": manifest.query,
}
ORACLE_SQL = {
    "op1_pivot_top_k": topk.ORACLE,
    "op2_suffix_automaton_dedup": substring_dedup.ORACLE,
    "op3_digest_index_dedup": exact_dedup.ORACLE,
    "op6_salvaging_warc": warc.ORACLE,
    "op7_fair_queue_mix": mixing.ORACLE,
    "op9_signature_tree_join": shingle_join.ORACLE,
    "op11_importance_resampling": resampling.ORACLE,
    "op13_merkle_manifest": manifest.ORACLE,
}
