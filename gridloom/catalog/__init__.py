"""All registered queries."""

from __future__ import annotations

import importlib

from gridloom.catalog.base import REGISTRY, Entry

MODULES = ["relational", "profile", "cleaning", "series", "statistics", "semantic", "findings", "models", "intake"]


def entries() -> dict[str, Entry]:
    for m in MODULES:
        try:
            importlib.import_module(f"gridloom.catalog.{m}")
        except ModuleNotFoundError as e:
            if not (e.name or "").startswith("gridloom.catalog."):
                raise
    return REGISTRY
