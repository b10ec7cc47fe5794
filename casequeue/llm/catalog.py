"""Queries of the corpus operators with their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "queries_native",
    "queries_tokens",
    "queries_models",
    "queries_dedup",
    "queries_pages",
    "queries_spelling",
)


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        merged.update(getattr(import_module(f"casequeue.llm.{name}"), attribute))
    return merged


def queries() -> dict:
    return _merged("QUERIES")


def oracles() -> dict:
    return _merged("ORACLES")
