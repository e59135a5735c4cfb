"""Queries of this package's operators over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from importlib import import_module

#: Module and function of each operator's query.
MODULES = {
    "op1_mixing": "mixing",
    "op2_line_dedup": "line_dedup",
    "op3_ngram_jaccard_join": "chosen_path",
    "op4_url_filters": "url_filters",
    "op4_url_filters_any_length": "url_filters",
    "op5_language_id": "language_id",
    "op6_nearest_neighbours": "nearest",
    "op7_warc": "warc",
    "op8_pii": "pii",
    "op9_media_gif": "gif",
    "op10_packing": "packing",
}


def queries() -> dict:
    return {name: getattr(import_module(f"strataforge.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    from strataforge.llm import oracles

    return dict(oracles.SQL)
