"""siltworks: preparation of text, code and conversation corpora as lazy PySpark plans."""

from siltworks.registry import available, get, register

__all__ = ["available", "get", "register"]
