"""Running sums over one global or per-key order, without a single-task window.

Rows are range-partitioned by (key, order) into slices, so even a key holding
a third of all rows is spread over many slices. Each slice is summed, the few
slice sums are prefix-summed, and a window inside each slice does the rest.
Only the thin (key, order, value) table takes part.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamlake.operators.restarts import restarting
from loamlake.runtime import cut_lineage


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"l.{n}").eqNullSafe(F.col(f"r.{n}")) for n in names])


def running_sum(
    df: DataFrame,
    value: Column,
    order: Sequence[str],
    by: Sequence[str] = (),
    *,
    slices: int | None = None,
    keep_slice: bool = False,
) -> DataFrame:
    """``by`` + ``order`` + ``value`` + ``before``: the sum of ``value`` over earlier rows of the key.

    ``order`` must identify a row within its key. Inclusive sum: ``before + value``.
    The number of slices follows the data's size unless ``slices`` sets it; with
    ``keep_slice`` the number of a row's slice comes as ``slice``.
    """
    thin = df.select(*by, *order, value.cast("bigint").alias("value"))
    # Range bounds come from a sample, so the slice of a row is written
    # down before it is used twice.
    sliced = cut_lineage(
        thin.repartitionByRange(*([slices] if slices else []), *by, *order).withColumn("slice", F.spark_partition_id())
    )
    sums = sliced.groupBy("slice", *by).agg(F.sum("value").alias("total"))
    # At most one row per (key, slice) takes part in this window.
    earlier = Window.partitionBy(*by).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("slice", *by, F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("offset"))
    if not by:
        offsets = F.broadcast(offsets)  # one row per slice
    keys = ["slice", *by]
    joined = sliced.alias("l").join(offsets.alias("r"), _same(sliced, offsets, keys)).select("l.*", "r.offset")
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.select(
        *by, *order, *(["slice"] if keep_slice else []), "value", (F.col("offset") + F.coalesce(F.sum("value").over(inside), F.lit(0))).alias("before")
    )


def row_number(df: DataFrame, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``by`` + ``order`` + ``position`` (from 1)."""
    counted = running_sum(df, F.lit(1), order, by)
    return counted.select(*by, *order, (F.col("before") + 1).alias("position"))


def within_budget(df: DataFrame, size: str, order: Sequence[str], target: int) -> DataFrame:
    """Rows in order until their total size reaches ``target``; the last one may overshoot.

    A row is refused only when the total already reached the target, so the
    kept rows are those up to one cut-off key: whole rows are filtered by that
    scalar and never shuffled. Sizes must not be negative.
    """
    sums = running_sum(df, F.col(size), order)
    kept = sums.filter(F.col("before") < target)
    cutoff = kept.agg(F.max(F.struct(*order)).alias("cutoff"))
    return df.filter(F.struct(*order) <= cutoff.scalar())


def assign_shards(df: DataFrame, size: str, order: Sequence[str], shard_size: int) -> DataFrame:
    """Add ``shard``: the count restarts at every shard, which is full with the record that reaches ``shard_size``."""
    return df.join(budgeted_shards(df, size, order, None, shard_size), list(order))


def budgeted_shards(thin: DataFrame, size: str, order: Sequence[str], target: int | None, shard_size: int, *, slices: int | None = None, **rules) -> DataFrame:
    """``order`` + ``shard`` of the rows within the budget: both follow from one running sum."""
    sums = running_sum(thin, F.col(size), order, slices=slices, keep_slice=True)
    kept = sums if target is None else sums.filter(F.col("before") < target)
    return restarting(cut_lineage(kept, "sums"), order, shard_size, **rules)
