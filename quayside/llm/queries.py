"""The queries of this subpackage, for the entry module."""

from __future__ import annotations

import importlib

MODULES = {
    "op1_benchmark_decontamination": "decontamination",
    "op2_byte_level_bpe": "bpe",
    "op3_exact_top_k": "topk",
    "op4_substring_dedup": "substring",
    "op5_line_dedup": "lines",
    "op6_language_id": "language",
    "page_language_id": "language",
    "op7_chat_formatting": "chat",
    "op8_simhash_near_dedup": "simhash",
    "op9_personal_data": "pii",
    "op10_token_counts": "token_counts",
    "op11_source_divergence": "divergence",
    "op12_minhash_near_dedup": "minhash",
    "op13_vector_codes": "vector_codes",
}


def _named(module: str, name: str):
    def run(spark, sf_dir):
        return getattr(importlib.import_module(module), name)(spark, sf_dir)

    run.__name__ = name
    return run


def queries() -> dict:
    found = {name: _named(f"quayside.llm.{module}", name) for name, module in MODULES.items()}
    return found | {"pipeline": _named("corpus_pipeline", "run")}


def oracle_sql() -> dict:
    from quayside.llm.sql import ORACLES

    return dict(ORACLES)
