"""Registered queries over the given tables."""

from __future__ import annotations

import importlib
import pkgutil


def load_all() -> None:
    for mod in pkgutil.iter_modules(__path__):
        if mod.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{mod.name}")
