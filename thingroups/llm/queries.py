"""The registered queries of this subpackage, each beside its SQL where SQL can express it."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None):
    def keep(fn):
        REGISTRY[name] = (fn, sql)
        return fn

    return keep


def load() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    """Import the modules of ``registered``; each adds its queries."""
    from thingroups.llm import registered

    for module in pkgutil.iter_modules(registered.__path__):
        importlib.import_module(f"{registered.__name__}.{module.name}")
    return REGISTRY
