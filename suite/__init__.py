"""Registered queries with their SQL oracles, over the warehouse tables."""

import importlib

MODULES = ("values", "library", "core", "stored", "ranking", "bills", "flows")


def load():
    """Import every module of cases and return the registry."""
    for name in MODULES:
        importlib.import_module(f"suite.{name}")
    base = importlib.import_module("suite.base")
    base.expand()
    return base
