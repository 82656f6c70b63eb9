"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

import importlib

#: The modules that exist, in the order of the operators.
MODULES = ("ngram_join", "toxicity", "mixing", "lm_scoring", "quality", "packing", "licences", "media", "wavelet", "fingerprints", "prefix_trie", "language_id", "search")


def _modules():
    return [importlib.import_module(f"lidaraudit.llm.{name}") for name in MODULES]


def queries() -> dict:
    return {name: f for module in _modules() for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _modules() for name, sql in module.ORACLE.items()}
