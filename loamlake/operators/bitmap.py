"""A one-hash Bloom filter as a small table: rows surely absent skip a join.

Bits stand in bitmaps of 32,768, one row each, so the filter is built by partial aggregation and
has at most ``MOST`` bits (16 MB). With more keys than that it lets more through and loses nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST, MOST = 1 << 15, 1 << 27


def bits_for(keys: int) -> int:
    """A power of two with eight bits a key, within bounds."""
    return min(max(1 << (8 * max(keys, 1)).bit_length(), LEAST), MOST)


def _place(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits)) + 1


def bitmaps(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """_bucket, _bits of the keys."""
    place = _place(F.col(key), bits)
    return keys.groupBy(F.bitmap_bucket_number(place).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bits"))


def maybe_in(df: DataFrame, key: str, filter_: DataFrame, bits: int) -> DataFrame:
    """``df`` with ``_maybe``: false when the key is surely not among those of ``filter_``, made with as many ``bits``."""
    place = _place(F.col(key), bits)
    met = df.withColumns({"_bucket": F.bitmap_bucket_number(place), "_bit": F.bitmap_bit_position(place)}).join(F.broadcast(filter_), "_bucket", "left")
    byte = F.expr("cast(conv(hex(substring(_bits, cast(_bit div 8 AS int) + 1, 1)), 16, 10) AS int)")
    held = F.expr("shiftright({0}, cast(_bit % 8 AS int)) & 1 = 1".format("_byte"))
    return met.withColumn("_byte", byte).withColumn("_maybe", F.coalesce(held, F.lit(False))).drop("_bucket", "_bit", "_bits", "_byte")


def left_anti(df: DataFrame, keys: DataFrame, key: str, count: int) -> DataFrame:
    """Rows of ``df``, which should be cheap to read again, whose key is not among the ``count`` ones of ``keys``."""
    bits = bits_for(count)
    marked = maybe_in(df, key, bitmaps(keys, key, bits), bits)
    sure = marked.filter("NOT _maybe").drop("_maybe")
    return sure.unionByName(marked.filter("_maybe").drop("_maybe").join(keys.select(key).distinct(), key, "left_anti"))
