"""Registry of the library's named queries and of their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Modules of ``loomspark.plans``; each has QUERIES and ORACLES.
PLANS: tuple[str, ...] = ("stream_plans", "graph_plans", "derived_plans", "context_plans")


def _merged(what: str) -> dict:
    out: dict = {}
    for name in PLANS:
        found = getattr(import_module(f"loomspark.plans.{name}"), what)
        if twice := out.keys() & found.keys():
            raise ValueError(f"registered twice: {sorted(twice)}")
        out |= found
    return out


def queries() -> dict[str, Query]:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLES")
