"""Queries over the stored tables, one or more for each operator of the inventory."""

from .base import REGISTRY, Plan, plan


def all_plans() -> list[Plan]:
    from . import files, intervals, models, relational, statistics, streams, text, vectors  # noqa: F401

    return list(REGISTRY.values())
