"""Operators by name, so that a pipeline can be written as configuration."""

from __future__ import annotations

from collections.abc import Callable

_OPERATORS: dict[str, Callable] = {}


def register(name: str | None = None) -> Callable[[Callable], Callable]:
    def put(f: Callable) -> Callable:
        _OPERATORS[name or f.__name__] = f
        return f

    return put


def _load() -> None:
    import importlib
    import pkgutil

    import siltworks.operators as here

    for m in pkgutil.iter_modules(here.__path__):
        importlib.import_module(f"{here.__name__}.{m.name}")


def get(name: str) -> Callable:
    _load()
    return _OPERATORS[name]


def available() -> list[str]:
    _load()
    return sorted(_OPERATORS)
