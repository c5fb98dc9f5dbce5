"""Registered queries: each runs a library operator over the driver tables."""

from __future__ import annotations

import importlib

MODULES = ["clean", "lookup", "panel", "profile", "spatial", "index", "econ", "dependence", "io"]


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"terrapanel.catalog.{name}")
