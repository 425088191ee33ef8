"""Queries that bind the operators to the driver's tables, with their SQL oracles."""

from __future__ import annotations

import importlib
import pkgutil


def load_all() -> None:
    for module in pkgutil.iter_modules(__path__):
        if module.name.startswith("on_"):
            importlib.import_module(f"{__name__}.{module.name}")
