"""Registered queries: one per operator, each with the SQL another engine can check it by."""

from __future__ import annotations

import importlib
from types import ModuleType

SECTIONS = ("scans", "columns", "filters", "joins", "aggregates", "reshape", "charts", "traces", "statistics", "models")


def load() -> ModuleType:
    """The registry with every section imported."""
    for name in SECTIONS:
        importlib.import_module(f"limnos.catalog.{name}")
    return importlib.import_module("limnos.catalog.registry")
