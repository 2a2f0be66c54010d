"""Counts that restart: where each shard begins when a shard is full with the record that reaches its size.

Where a shard begins depends on where the one before began, so the beginnings are a
chain through all records. It is found without walking it: in every slice of the prefix sums
a search gives each possible first beginning the one that follows, and pointer
doubling the beginning at which the chain leaves the slice. Only records within one shard size of a
slice's start can be its first beginning, so few rows remain; their successors are found by one
sorted search, and pointer doubling over them marks those the chain does meet, in as many rounds as the
number of slices has binary digits. Each slice then numbers its own rows.

What is held by one task is one slice of numbers; what meets in one place is one row per slice.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamlake.runtime import cut_lineage

TOGETHER = 1 << 20


def leaving(starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the sorted ``starts``: the sum at which a chain that begins there leaves them, and its steps until then."""
    after = np.searchsorted(starts, starts + size)
    last, steps = np.arange(len(starts)), np.ones(len(starts), np.int64)
    while True:
        inside = np.flatnonzero(after < len(starts))
        if not len(inside):
            return starts[last] + size, steps
        to = after[inside]
        last[inside], steps[inside], after[inside] = last[to], steps[inside] + steps[to], after[to]


def restarting(sums: DataFrame, order: Sequence[str], size: int, together: int = TOGETHER) -> DataFrame:
    """``order`` + ``shard`` of ``sums`` (order, slice, value, before), which should be cheap to read again.

    Shards count from 0. Rows without a size go with the record after them. Up to ``together`` possible
    first beginnings are followed by one task, more by pointer doubling.
    """

    def entries(slice_: pd.DataFrame) -> pd.DataFrame:
        starts = np.sort(slice_["before"].to_numpy(np.int64))
        out, steps = leaving(starts, size)
        few = int(np.searchsorted(starts, starts[0] + size)) + 1
        return pd.DataFrame({"slice": slice_["slice"].iloc[0], "entry": starts[:few], "out": out[:few], "steps": steps[:few]})

    parts = sums.select("slice").distinct()
    if parts.count() < 2:  # the chain never leaves its slice
        state = parts.select("slice", F.lit(0).cast("bigint").alias("_next"), F.lit(0).cast("bigint").alias("_at"))
    else:
        sized = sums.filter("value > 0").select("slice", "before")
        found = cut_lineage(sized.groupBy("slice").applyInPandas(entries, "slice int, entry bigint, out bigint, steps bigint"), "entries")
        # What a slice begins with: the next shard's number and the sum at which it begins.
        chain = _walk(found) if found.count() <= together else _chain(found)
        met = parts.join(chain.select("slice", "number", "out", "steps"), "slice", "left")
        earlier = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
        state = met.select(
            "slice",
            F.coalesce(F.last(F.col("number") + F.col("steps"), True).over(earlier), F.lit(0)).alias("_next"),
            F.coalesce(F.last("out", True).over(earlier), F.lit(0)).alias("_at"),
        )

    def numbered(slice_: pa.Table) -> pa.Table:
        before = slice_.column("before").to_numpy()
        starts = np.sort(before[slice_.column("value").to_numpy() > 0])
        number, at = slice_.column("_next")[0].as_py(), slice_.column("_at")[0].as_py()
        begins = [at]
        while (place := int(np.searchsorted(starts, begins[-1]))) < len(starts):
            begins.append(int(starts[place]) + size)
        shard = number - 1 + np.searchsorted(np.array(begins), before, "right")
        return slice_.select(list(order)).append_column("shard", pa.array(shard.astype(np.int32)))

    made = T.StructType([*[sums.schema[c] for c in order], T.StructField("shard", T.IntegerType())])
    return sums.join(F.broadcast(state), "slice").groupBy("slice").applyInArrow(numbered, made)


def _walk(found: DataFrame) -> DataFrame:
    """As ``_chain``, by one task that goes from slice to slice."""

    def follow(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("entry")
        entry, out, steps = (rows[c].to_numpy(np.int64) for c in ("entry", "out", "steps"))
        to, at, number, met, numbers = np.searchsorted(entry, out), 0, 0, [], []
        while at < len(entry):
            met.append(at)
            numbers.append(number)
            at, number = int(to[at]), number + int(steps[at])
        return rows.iloc[met].assign(number=numbers)[["slice", "number", "out", "steps"]]

    return found.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(follow, "slice int, number bigint, out bigint, steps bigint")


def _chain(found: DataFrame) -> DataFrame:
    """slice, number, out, steps of the entries that the chain from the least one meets; ``number`` counts beginnings before."""
    # The least entry at or after each sum where a chain leaves: entries and sums in one order.
    asked = found.select(F.col("entry").alias("at"), "entry").unionByName(found.select(F.col("out").alias("at"), F.lit(None).cast("bigint").alias("entry")).distinct())
    ranged = cut_lineage(asked.repartitionByRange("at").withColumn("part", F.spark_partition_id()), "ranged")
    least = ranged.groupBy("part").agg(F.min("entry").alias("least"))
    later = least.select("part", F.min("least").over(Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)).alias("later"))  # one row per part
    here = F.min("entry").over(Window.partitionBy("part").orderBy(F.desc("at"), F.col("entry").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    answered = ranged.withColumn("here", here).filter("entry IS NULL").join(F.broadcast(later), "part").select(F.col("at").alias("out"), F.coalesce("here", "later").alias("to"))
    jumps = cut_lineage(found.join(answered, "out").filter("to IS NOT NULL").select("entry", "to", "steps"), "jumps")
    met = cut_lineage(found.agg(F.min("entry").alias("entry")).filter("entry IS NOT NULL").withColumn("number", F.lit(0).cast("bigint")), "met")
    while True:
        further = met.join(jumps, "entry").select(F.col("to").alias("entry"), (F.col("number") + F.col("steps")).alias("number"))
        further = cut_lineage(further, "met")
        if further.isEmpty():
            return met.join(found, "entry")
        met = met.unionByName(further)
        second = jumps.select(F.col("entry").alias("to"), F.col("to").alias("beyond"), F.col("steps").alias("more"))
        jumps = cut_lineage(jumps.join(second, "to").select("entry", F.col("beyond").alias("to"), (F.col("steps") + F.col("more")).alias("steps")), "jumps")
