"""Every operator as a query over the driver's test tables, each with its SQL check where SQL can
express it."""

from __future__ import annotations

import importlib

from .registry import ORACLES, QUERIES

MODULES = ["market", "joins", "posts", "sentiment", "text", "dims", "trading", "council", "web", "streams", "files", "rules"]


def load_all():
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return QUERIES, ORACLES
