"""Loads every query of this folder."""

from __future__ import annotations

import importlib

from .common import ORACLES, QUERIES

MODULES = [
    "piece_dropout", "token_files", "mixing", "secret_ledger", "quality_ledger", "near_copies", "surrogates",
    "line_blocks", "radix_dedup", "chat_layouts", "filter_audit", "count_tree", "prefix_trie",
]


def load_all():
    for name in MODULES:
        importlib.import_module(f"{__package__}.{name}")
    return QUERIES, ORACLES
