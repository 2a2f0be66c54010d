"""Columns that are evaluated once per row, whatever refers to them later."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add or replace columns behind a one-row generator.

    Filters and projections are inlined into what they refer to, so a costly
    text expression used by two conditions runs for each. They are not moved
    below a generator, and reading its output costs nothing.
    """
    kept = [c for c in df.columns if c not in columns]
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*kept, F.inline(F.array(made)))
