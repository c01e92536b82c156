"""Operators for training data of language models. Nothing outside this subpackage imports it."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable


def _modules() -> list:
    return [importlib.import_module(f"{__name__}.{m.name}") for m in pkgutil.iter_modules(__path__) if m.name.startswith("q_")]


def queries() -> dict[str, Callable]:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in getattr(m, "SQL", {}).items()}
