"""The queries of this folder's operators and their SQL."""

from __future__ import annotations

import importlib

#: Query name: (module, SQL or None).
NAMES = {
    "op4_shingle_join": "shingle_join",
    "op5_personal_data": "personal_data",
    "op10_quality_classifier": "quality_classifier",
    "op8_html_text": "html_text",
    "op6_embedding_range_join": "embedding_join",
    "op7_quality_rules": "quality_rules",
    "op9_entropy_mixing": "mixing",
    "op1_line_dedup": "line_dedup",
    "op2_token_shards": "token_shards",
    "op3_best_fit_packing": "packing",
    "op11_byte_bpe": "byte_bpe",
    "op12_annulus_clusters": "centroid_clusters",
    "op13_prefix_trie": "prefix_trie",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"fuseline.llm.{module}"), name) for name, module in NAMES.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for module in dict.fromkeys(NAMES.values()):
        out |= getattr(importlib.import_module(f"fuseline.llm.{module}"), "ORACLE_SQL", {})
    return out
