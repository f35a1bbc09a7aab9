"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = [
    "op01_licenses", "op02_decontaminate", "op03_language", "op04_spans", "op05_bytebpe",
    "op06_chat", "op07_media", "op08_warc", "op09_probminhash", "op10_extract", "op11_jaccard", "op12_importance", "op13_alignment",
]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in import_module(f"tillroll.llm.{m}").QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in import_module(f"tillroll.llm.{m}").ORACLES.items()}
