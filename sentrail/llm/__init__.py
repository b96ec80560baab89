"""Operators for text and sequence training data. Nothing else in the library imports this package."""

from __future__ import annotations

import importlib
import pkgutil


def modules():
    names = sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name.startswith("queries_"))
    return [importlib.import_module(f"{__name__}.{n}") for n in names]
