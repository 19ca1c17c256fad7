"""Registry that pairs a Spark query with its checking SQL and its inventory ids."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

PLAN_MODULES = (
    "text_plans",
    "keyword_plans",
    "vector_plans",
    "search_plans",
    "ingest_plans",
    "dedup_plans",
    "report_plans",
    "intent_plans",
    "evidence_plans",
    "extraction_plans",
    "request_plans",
    "state_plans",
)


@dataclass(frozen=True)
class Registered:
    name: str
    run: Query
    oracle: str | None
    covers: str


_REGISTRY: dict[str, Registered] = {}


def register(name: str, oracle: str | None = None, covers: str = "") -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        if name in _REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        _REGISTRY[name] = Registered(name, fn, oracle, covers)
        return fn

    return keep


def registered() -> dict[str, Registered]:
    for module in PLAN_MODULES:
        import_module(f"dossierlake.plans.{module}")
    return dict(_REGISTRY)


def all_queries() -> dict[str, Query]:
    return {name: item.run for name, item in registered().items()}


def all_oracles() -> dict[str, str]:
    return {name: item.oracle for name, item in registered().items() if item.oracle}
