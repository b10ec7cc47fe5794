"""All registered queries and oracles."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "views",
    "queue",
    "volume",
    "sampling",
    "intake",
    "metrics",
    "evidence",
    "review",
    "router",
)


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        part = getattr(import_module(f"catalog.{name}"), attribute)
        clash = merged.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        merged.update(part)
    return merged


def queries() -> dict:
    return _merged("QUERIES")


def oracles() -> dict:
    return _merged("ORACLES")
