"""Every query of the library by name, with its SQL for another engine where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import all_plans


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {p.name: p.run for p in all_plans()}


def oracle_sql() -> dict[str, str]:
    return {p.name: p.oracle for p in all_plans() if p.oracle}
