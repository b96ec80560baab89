"""Registered queries of the core: each module has QUERIES and, where SQL can say it, ORACLES."""

from __future__ import annotations

import importlib
import pkgutil


def modules():
    return [importlib.import_module(f"{__name__}.{m.name}") for m in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name)]
