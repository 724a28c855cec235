"""Importing this module registers every query."""

import importlib
import pkgutil

import feedlake.plans as plans
from feedlake.plans.registry import ORACLES, QUERIES

for _module in sorted(m.name for m in pkgutil.iter_modules(plans.__path__)):
    if _module.startswith("run_"):
        importlib.import_module(f"feedlake.plans.{_module}")

__all__ = ["ORACLES", "QUERIES"]
