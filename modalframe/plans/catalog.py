"""Importing this module registers every query."""
import importlib

from modalframe.plans.registry import ORACLES, QUERIES

for _module in ("correlation", "frequency", "registration", "shapes", "spans", "sensitivity", "evidence", "linear", "records", "comparison"):
    importlib.import_module(f"modalframe.plans.{_module}")

__all__ = ["QUERIES", "ORACLES"]
