"""Registry of queries: name -> callable, name -> check SQL, name -> operator ids."""

from __future__ import annotations

import re

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
IDS: dict[str, str] = {}


def query(name: str, ids: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``; ``ids`` are the blueprint's operator ids."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        IDS[name] = ids
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


def with_ctes(ctes: dict[str, str], body: str, recursive: bool = False) -> str:
    """Prepend the shared views that ``body`` names, in declaration order, with what they need."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for cte in ctes:
            if cte not in needed and re.search(rf"\b{cte}\b", text):
                needed.add(cte)
                visit(ctes[cte])

    visit(body)
    parts = [f"{c} AS ({ctes[c]})" for c in ctes if c in needed]
    body = body.strip()
    head = re.match(r"(?is)^with\s+(recursive\s+)?", body)
    if head:
        recursive = recursive or bool(head.group(1))
        body = ", " + body[head.end():] if parts else body[head.end():]
    kind = "WITH RECURSIVE " if recursive else "WITH "
    if not parts and not head:
        return body
    return kind + ", ".join(parts) + " " + body
