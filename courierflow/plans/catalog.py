"""Registry of checked queries: name -> (Spark builder, oracle SQL or None).

A builder takes ``(spark, sf_dir)`` and returns a DataFrame over the logical
tables of that folder.  Registration happens at import of the plan modules
listed in :data:`PLAN_MODULES`.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    build: Builder
    sql: str | None
    survey_id: str


_REGISTRY: dict[str, Entry] = {}

PLAN_MODULES = [
    "courierflow.plans.views",
    "courierflow.plans.status_views",
    "courierflow.plans.position_views",
    "courierflow.plans.rule_views",
    "courierflow.plans.change_views",
    "courierflow.plans.intake_views",
    "courierflow.plans.geo_views",
]


def register(name: str, survey_id: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in _REGISTRY:
            raise ValueError(f"duplicate query {name}")
        _REGISTRY[name] = Entry(name, fn, sql, survey_id)
        return fn
    return deco


def load_all() -> dict[str, Entry]:
    for mod in PLAN_MODULES:
        try:
            importlib.import_module(mod)
        except ModuleNotFoundError as exc:
            if exc.name != mod:
                raise
    return dict(_REGISTRY)
