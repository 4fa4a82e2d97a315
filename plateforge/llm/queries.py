"""The opN_<name> queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

import importlib

#: query name -> module; each module defines a function of the query's name.
MODULES = {
    "op1_ann": "ann",
    "op2_toxicity": "toxicity",
    "op3_packing": "packing",
    "op4_hmm": "hmm",
    "op5_quality": "quality_classifier",
    "op6_quality_rules": "quality_rules",
    "op7_secrets": "secrets",
    "op8_near_dedup": "near_dedup",
    "op9_bpe": "bpe",
    "op10_suffix_dedup": "suffix_dedup",
    "op11_prefix_trie": "prefix_trie",
    "op12_spelling": "spelling",
    "op13_chat_format": "chat_format",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, module in MODULES.items() if (sql := getattr(importlib.import_module(f"{__package__}.{module}"), "ORACLE_SQL", None))}
