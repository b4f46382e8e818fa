"""Queries over the driver's tables: name -> (query, oracle SQL or None)."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def collect() -> tuple[dict[str, Query], dict[str, str]]:
    """All queries of the modules of this package, and the SQL of those that have one."""
    queries: dict[str, Query] = {}
    oracles: dict[str, str] = {}
    for info in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name):
        module = importlib.import_module(f"{__name__}.{info.name}")
        for name, query in module.QUERIES.items():
            if name in queries:
                raise ValueError(f"two queries are named {name}")
            queries[name] = query
        oracles |= module.ORACLES
    return queries, oracles
