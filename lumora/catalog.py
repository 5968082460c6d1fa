"""Imports every module that registers queries."""

from __future__ import annotations

import importlib

MODULES = [
    "lumora.operators.timestamps",
    "lumora.operators.nearby",
    "lumora.operators.geo",
    "lumora.operators.library",
    "lumora.operators.search",
    "lumora.operators.pipeline",
    "lumora.operators.people",
    "lumora.operators.suggest",
    "lumora.operators.fleet",
    "lumora.operators.story",
    "lumora.operators.curation",
    "lumora.streaming.flows",
]


def load() -> None:
    """Register the queries of the core."""
    for m in MODULES:
        importlib.import_module(m)
