"""The queries of this subpackage and their SQL; __spark_entry__ adds them when it can import this."""

from __future__ import annotations

import importlib

#: Query name -> module. Each module has a function of the query's name, and SQL where SQL can say it.
MODULES = {
    "op1_line_dedup": "line_dedup",
    "op2_lang_id": "lang_id",
    "op3_suffix_dedup": "suffix_dedup",
    "op4_near_join": "near_join",
    "op5_chat_format": "chat_format",
    "op6_quality": "quality",
    "op7_decontaminate": "decontaminate",
    "op8_packing": "packing",
    "op9_embedding_dedup": "embedding_dedup",
    "op10_url_filters": "url_filter",
}


def queries() -> dict:
    return {n: getattr(importlib.import_module(f"{__package__}.{m}"), n) for n, m in MODULES.items()}


def oracle_sql() -> dict:
    found = {n: getattr(importlib.import_module(f"{__package__}.{m}"), "SQL", None) for n, m in MODULES.items()}
    return {n: s for n, s in found.items() if s}
