"""Registered queries. Importing the modules fills the registry."""

import importlib

from loamlake.queries.base import ORACLE, QUERIES

MODULES = ["corpus", "reports", "governance", "loads"]

for _module in MODULES:
    importlib.import_module(f"loamlake.queries.{_module}")

__all__ = ["ORACLE", "QUERIES"]
