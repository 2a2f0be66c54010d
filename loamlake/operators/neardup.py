"""Near-duplicate removal: MinHash signatures, LSH bands, keep-first.

A text is dropped when it shares a band with an earlier text that was itself
kept. That is the lexicographically first maximal independent set of the
collision graph; it is found on the (text, bucket) table, so a bucket
of m texts costs m rows and never m^2 pairs.

Rounds that settle every text ahead of all its neighbours end groups of copies
fast and long chains of versions slowly. Chains are settled together instead:
the open texts fall apart into connected components, and the first texts of every component, up to
a bounded number, are settled one after the other by one task. What is open in
the end is one such batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loamlake.functions.text import dedup_key, squeeze
from loamlake.operators.corpus import first_rows
from loamlake.operators.running import row_number
from loamlake.operators.skew import lookup
from loamlake.runtime import cut_lineage

SEED = 20240229
GRAM_BASE, GRAM_MIX = 0x343FD3B5, 0x2C1B3C6D
# So many texts are settled in one task, with their buckets.
TOGETHER = 1 << 15


@lru_cache(maxsize=None)
def band_layout(threshold: float, num_perm: int) -> tuple[int, int]:
    """(bands, rows) with the least equal-weight sum of false positive and false negative area."""
    s = (np.arange(2000) + 0.5) / 2000
    best, layout = float("inf"), (1, 1)
    for bands in range(1, num_perm + 1):
        for rows in range(1, num_perm // bands + 1):
            hit = 1.0 - (1.0 - s**rows) ** bands
            error = (hit[s < threshold].sum() + (1.0 - hit[s >= threshold]).sum()) / len(s)
            if error < best:
                best, layout = error, (bands, rows)
    return layout


def gram_hashes(text: str, n: int) -> np.ndarray:
    """One 32-bit hash per distinct character ``n``-gram of an already squeezed text."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    if len(points) == 0:
        return points
    width = min(n, len(points))
    grams = np.zeros(len(points) - width + 1, dtype=np.uint32)
    for offset in range(width):
        grams = grams * np.uint32(GRAM_BASE) + points[offset : offset + len(grams)]
    grams *= np.uint32(GRAM_MIX)
    return np.unique(grams ^ (grams >> np.uint32(15)))


@lru_cache(maxsize=None)
def permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands of the hash functions h -> a h + b on 32 bits."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 2**30, size=count, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, size=count, dtype=np.uint32)


def _signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = 4096) -> np.ndarray:
    lowest = np.full(len(a), np.iinfo(np.uint32).max, dtype=np.uint32)
    for start in range(0, len(hashes), block):
        part = hashes[start : start + block]
        lowest = np.minimum(lowest, (a[:, None] * part[None, :] + b[:, None]).min(axis=1))
    return lowest


def band_buckets(text: Column, *, threshold: float = 0.8, num_perm: int = 128, n: int = 5) -> Column:
    """Array of bucket ids, one per band; empty for an empty text."""
    bands, rows = band_layout(threshold, num_perm)
    a, b = permutations(bands * rows)

    @F.pandas_udf("array<binary>")
    def buckets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(squeezed: str) -> list[bytes]:
            hashes = gram_hashes(squeezed or "", n)
            if len(hashes) == 0:
                return []
            parts = _signature(hashes, a, b).reshape(bands, rows)
            return [hashlib.blake2b(bytes([i]) + part.tobytes(), digest_size=16).digest() for i, part in enumerate(parts)]

        for batch in batches:
            yield batch.map(one)

    return buckets(squeeze(text))


def bucket_rows(df: DataFrame, order: str, **rules) -> DataFrame:
    """One (id, bucket) row per text and band."""
    return df.select(F.col(order).alias("id"), F.explode(band_buckets(F.col("text"), **rules)).alias("bucket"))


def _shared(rows: DataFrame) -> DataFrame:
    """(id, bucket, first): rows of buckets two or more ids share, with the bucket's least id."""
    least = rows.groupBy("bucket").agg(F.min("id").alias("first"), F.count("*").alias("members"))
    return lookup(rows, least.filter("members > 1").drop("members"), "bucket")


def _settled(rows: DataFrame) -> DataFrame:
    """(id, kept) of the ids of (group, id, bucket): each group is one task's, its ids one after the other."""

    def in_turn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", kind="stable")
        ids, buckets = group["id"].tolist(), group["bucket"].tolist()
        taken, out, begin = set(), [], 0
        for end in range(1, len(ids) + 1):
            if end == len(ids) or ids[end] != ids[begin]:
                own = buckets[begin:end]
                kept = taken.isdisjoint(own)
                if kept:
                    taken.update(own)
                out.append((ids[begin], kept))
                begin = end
        return pd.DataFrame(out, columns=["id", "kept"])

    return rows.groupBy("group").applyInPandas(in_turn, f"id {rows.schema['id'].dataType.simpleString()}, kept boolean")


def _components(rows: DataFrame) -> DataFrame:
    """(id, group): the least id reachable over shared buckets. A chain of n ids takes log2(n) rounds."""
    labels = cut_lineage(rows.groupBy("id").agg(F.min("first").alias("group")))
    while True:
        least = rows.join(labels, "id").groupBy("bucket").agg(F.min("group").alias("least"))
        near = lookup(rows.select("id", "bucket"), least, "bucket").groupBy("id").agg(F.min("least").alias("near"))
        beyond = labels.select(F.col("id").alias("near"), F.col("group").alias("beyond"))
        moved = labels.join(near, "id").join(beyond, "near", "left").select("id", F.col("group").alias("old"), F.least("near", "beyond").alias("group"))
        moved = cut_lineage(moved)
        labels = moved.select("id", "group")
        if moved.filter("group <> old").isEmpty():
            return labels


def dropped_ids(rows: DataFrame, together: int = TOGETHER) -> DataFrame:
    """Ids dropped by keep-first over (id, bucket) rows, which should be cheap to read again.

    A round settles every id that leads all its shared buckets (kept) and every id that shares a
    bucket with such a leader (dropped). A round that leaves more than half open is followed by batches:
    the first ``together`` open ids of every component. The last ``together`` ids are one batch.
    """
    if isinstance(rows.schema["id"].dataType, StructType):  # a number per id keeps the order
        places = cut_lineage(row_number(rows.select("id").distinct(), ["id"]))
        numbered = cut_lineage(rows.join(places, "id").select(F.col("position").alias("id"), "bucket"))
        return dropped_ids(numbered, together).withColumnRenamed("id", "position").join(places, "position").select("id")
    lost, groups = [], None
    shared = cut_lineage(_shared(rows))
    left = shared.select("id").distinct().count()
    while left:
        if left <= together:
            fate = cut_lineage(_settled(shared.select(F.lit(0).alias("group"), "id", "bucket")))
            lost.append(fate.filter("NOT kept").select("id"))
            break
        leads = F.min(F.col("id") == F.col("first")).alias("leads")
        leaders = shared.groupBy("id").agg(leads).filter("leads").select(F.col("id").alias("first"), F.lit(True).alias("taken"))
        # A leader is the first of all its buckets, so meeting it on ``first`` means sharing a bucket.
        met = lookup(shared, leaders, "first", "left")
        fate = cut_lineage(met.groupBy("id").agg(leads, F.max(F.col("taken")).alias("near_kept")))
        lost.append(fate.filter("near_kept AND NOT leads").select("id"))
        shared = _open(shared, fate.filter("near_kept IS NULL").select("id"))
        before, left = left, shared.select("id").distinct().count()
        if together < left and 2 * left > before:
            if groups is None:  # components only shrink, so one division serves all later rounds
                groups = _components(shared)
            known = cut_lineage(shared.select("id").distinct().join(groups, "id"))
            early = row_number(known, ["id"], ["group"]).filter(F.col("position") <= together).select("group", "id")
            fate = cut_lineage(_settled(shared.join(early, "id").select("group", "id", "bucket")))
            lost.append(fate.filter("NOT kept").select("id"))
            taken = shared.join(fate.filter("kept"), "id").select("bucket").distinct().withColumn("taken", F.lit(True))
            near = lookup(shared.join(fate, "id", "left_anti").select("id", "bucket"), taken, "bucket", "left")
            near = cut_lineage(near.groupBy("id").agg(F.max("taken").alias("taken")))
            lost.append(near.filter("taken").select("id"))
            shared = _open(shared, near.filter("taken IS NULL").select("id"))
            left = shared.select("id").distinct().count()
    return reduce(DataFrame.unionByName, lost, rows.select("id").limit(0))


def _open(shared: DataFrame, ids: DataFrame) -> DataFrame:
    return cut_lineage(_shared(cut_lineage(shared.select("id", "bucket").join(ids, "id", "left_semi"))))


def near_rows(rows: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """Ids of (id, bucket) that are dropped: those with a bucket of ``taken``, then by keep-first. ``rows`` should be cheap to read again."""
    if taken is None:
        return dropped_ids(rows).select("id")
    near_taken = cut_lineage(lookup(rows, taken.select("bucket").distinct(), "bucket").select("id").distinct())
    return near_taken.unionByName(dropped_ids(rows.join(near_taken, "id", "left_anti")).select("id"))


def near_dedup(df: DataFrame, order: str = "doc_id", written: DataFrame | None = None, **rules) -> DataFrame:
    """Exact copies go first; then texts near an earlier kept one or any text of ``written``. ``order`` must identify a text.

    Signatures are taken where texts are read, those of copies too, so no text is shuffled.
    """
    unique = cut_lineage(first_rows(df, dedup_key(F.col("text")), (order,)))
    signed = cut_lineage(df.select(F.col(order).alias("id"), band_buckets(F.col("text"), **rules).alias("buckets")))
    first = signed.join(unique.withColumnRenamed(order, "id"), "id", "left_semi")
    rows = cut_lineage(first.select("id", F.explode("buckets").alias("bucket")))
    taken = None if written is None else written.filter(F.col("text") != "").select(F.explode(band_buckets(F.col("text"), **rules)).alias("bucket"))
    dropped = near_rows(rows, taken).select(F.col("id").alias(order))
    return df.join(unique.join(dropped, order, "left_anti"), order, "left_semi")
