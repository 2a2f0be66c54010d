"""Lookup join that stays balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Keys above 1/HOT_SHARE of all rows: at most HOT_SHARE of them can exist.
HOT_SHARE = 1000


def lookup(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join ``rows`` to ``table``, which holds at most one row per ``key``; ``how`` is inner or left.

    The at most HOT_SHARE hot keys are broadcast with their table row, so their
    rows never move. All other rows join by shuffle, where no key is hot.
    ``rows`` is read three times: pass something cheap to read again.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("_size"))
    total = rows.agg(F.count("*"))
    hot = sizes.filter(F.col("_size") * HOT_SHARE > total.scalar()).select(key)
    hot_table = F.broadcast(hot.join(table, key, how))
    cold = rows.join(F.broadcast(hot), key, "left_anti").join(table, key, how)
    return rows.join(hot_table, key).unionByName(cold)
