"""Queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from packetrisk.llm.oracle import ORACLE

#: query -> module of this subpackage that defines it
WHERE = {
    "op1_cumulative_link": "ordinal",
    "op2_winnowing": "decontamination",
    "op3_class_kneser_ney": "toxicity",
    "op4_hilbert_packing": "packing",
    "op5_coordinate_join": "near_duplicates",
    "op6_chat_parts": "chat",
    "op7_perplexity_bands": "perplexity_rules",
    "op8_html_blocks": "html",
    "op9_license_index": "licenses",
    "op10_two_stage_suffixes": "repeated_bytes",
    "op11_dynamic_phrases": "collocations",
    "op12_kneser_ney_language": "language_id",
    "op13_zfast_trie": "prefix_trie",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(importlib.import_module(f"packetrisk.llm.{module}"), name) for name, module in WHERE.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
