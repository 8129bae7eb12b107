"""Registered queries over the shared tables, each with its SQL statement where one exists."""

from __future__ import annotations

import importlib

from ledgerlens.catalog.registry import QUERIES, Registered

MODULES = ("segments", "profiling", "scores", "recommenders", "lifetime", "neighbours", "modelling")


def load() -> dict[str, Registered]:
    """All registered queries by name."""
    for module in MODULES:
        importlib.import_module(f"ledgerlens.catalog.{module}")
    return QUERIES
