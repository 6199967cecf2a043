"""The queries of this subpackage and the SQL that they can be held against."""

from __future__ import annotations

from siltworks.llm import bpe, chat, language_id, line_dedup, packing, pii, prefix_trie, quality_classifier, quality_rules, simhash, structure, topk, toxicity

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_chat_formatting": chat.op3_chat_formatting,
    "op4_topk_segments": topk.op4_topk_segments,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_byte_bpe": bpe.op7_byte_bpe,
    "op8_quality_classifier": quality_classifier.op8_quality_classifier,
    "op9_simhash": simhash.op9_simhash,
    "op10_pii_contexts": pii.op10_pii_contexts,
    "op11_structure_repair": structure.op11_structure_repair,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}
ORACLES = {
    "op3_chat_formatting": chat.SQL,
    "op4_topk_segments": topk.SQL,
    "op5_quality_rules": quality_rules.SQL,
    "op11_structure_repair": structure.SQL,
    "op13_prefix_trie": prefix_trie.SQL,
}
