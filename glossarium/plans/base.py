"""A registry of queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Plan:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    rows: str


REGISTRY: dict[str, Plan] = {}


def plan(rows: str, oracle: str | None = None, name: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame. rows: what it covers of the operator inventory; oracle: the same in SQL."""

    def add(run):
        p = Plan(name or run.__name__, run, oracle, rows)
        if p.name in REGISTRY:
            raise ValueError(f"two plans are called {p.name}")
        REGISTRY[p.name] = p
        return run

    return add
