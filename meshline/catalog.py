"""All core queries and their SQL, by name."""

from __future__ import annotations

from importlib import import_module

MODULES = ("meshline.operators.queries", "meshline.plans.metrics", "meshline.plans.navigation", "meshline.plans.analysis", "meshline.plans.exchange", "meshline.plans.reports", "meshline.plans.lookups")


def queries() -> dict:
    return {k: v for m in MODULES for k, v in import_module(m).QUERIES.items()}


def oracles() -> dict:
    return {k: v for m in MODULES for k, v in import_module(m).ORACLES.items()}
