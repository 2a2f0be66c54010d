"""Order MinHash fingerprints, in DataFrame functions alone.

The words of a text give k-mers (k words in a row), numbered by occurrence, so a
repeated k-mer counts as often as it stands. Each of ``slots`` hash functions picks the ``tuple_size``
least of all of them, puts them into text order and hashes that tuple. Texts with the same k-mers in
another order therefore differ, as edit distance has it. Likeness is the
share of equal slots.

The functions are one 40-bit hash with its zero moved: function j counts from point j of
``slots`` evenly spaced ones, past the greatest value on to the least. Each is a random order of the k-mers, so a slot
is equal as often as with functions of their own, and its least k-mers are those that follow its point among
all sorted ones, found by halving: the k-mers are hashed and sorted once, not once a function.

Sorted numbers hold 40 bits of hash and 24 bits of place: beyond 16.7 million words places repeat
and only the order inside a tuple may differ. Cases: a null text is an
empty one, whose fingerprint is that of one empty word; a text shorter than k words is one k-mer;
ties are equal hashes, put in text order; repeated rows follow each other; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamlake.operators.once import with_once

PLACE = (1 << 24) - 1


def _packed(value: Column, place: Column) -> Column:
    return F.coalesce(value.bitwiseAND(F.lit(~PLACE)).bitwiseOR(place.cast("bigint")), F.lit(0).cast("bigint"))


def _hash(packed: Column) -> Column:
    return F.shiftright(packed, 24)


def with_fingerprint(df: DataFrame, text: str, name: str, *, k: int = 3, slots: int = 32, tuple_size: int = 2) -> DataFrame:
    """Adds ``name``: an array of ``slots`` 64-bit numbers. Every step stands behind a generator, so none is computed twice."""
    at = lambda a, i: F.get(F.col(a), i)
    df = with_once(df, {"_words": F.split(F.coalesce(F.col(text), F.lit("")), r"\s+")})
    n = F.size("_words")
    kmer = lambda i: _packed(F.xxhash64(*[at("_words", i + j) for j in range(k)]), i)
    kmers = F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), kmer)).otherwise(F.array(_packed(F.xxhash64("_words"), F.lit(0))))
    df = with_once(df.withColumn("_kmers", kmers).drop("_words"), {"_sorted": F.sort_array("_kmers")}).drop("_kmers")
    first = F.filter(F.sequence(F.lit(0), F.size("_sorted") - 1), lambda i: (i == 0) | (_hash(at("_sorted", i)) != _hash(at("_sorted", i - 1))))
    df = with_once(df, {"_first": first})
    # The i-th of the equal k-mers from ``begin`` on is occurrence i - begin.
    numbered = lambda begin: lambda i: _packed(F.xxhash64(_hash(at("_sorted", i)), i - begin), at("_sorted", i).bitwiseAND(F.lit(PLACE)))
    runs = F.transform("_first", lambda begin, r: F.transform(F.sequence(begin, F.coalesce(at("_first", r + 1), F.size("_sorted")) - 1), numbered(begin)))
    df = with_once(df, {"_all": F.flatten(runs)}).drop("_sorted", "_first")
    df = with_once(df, {"_sorted": F.sort_array("_all")}).drop("_all")
    size = F.size("_sorted")
    df = with_once(df, {"_halvings": F.sequence(F.lit(1), F.length(F.bin(size)))})

    def least_from(point: Column) -> Column:
        """Number of the first hash at or above ``point``, by halving."""

        def halve(s: Column, _: Column) -> Column:
            middle = F.shiftright(s["low"] + s["high"], 1)
            upper = F.struct((middle + 1).alias("low"), s["high"].alias("high"))
            lower = F.struct(s["low"].alias("low"), middle.alias("high"))
            return F.when(s["low"] >= s["high"], s).when(at("_sorted", middle) < point, upper).otherwise(lower)

        return F.aggregate("_halvings", F.struct(F.lit(0).alias("low"), size.alias("high")), halve, lambda s: s["low"])

    def tuple_from(i: Column) -> Column:
        """Hash of the ``tuple_size`` hashes from number ``i`` on, which go on at the start, in text order."""
        packed = [at("_sorted", (i + t) % size) for t in range(tuple_size)]
        held = [F.when(F.lit(t) < size, F.struct(p.bitwiseAND(F.lit(PLACE)).alias("place"), _hash(p).alias("value"))) for t, p in enumerate(packed)]
        return F.xxhash64(F.transform(F.array_sort(F.array_compact(F.array(*held))), lambda s: s["value"]))

    points = F.array(*[F.lit((j << 64) // slots - (1 << 63)) for j in range(slots)]).cast("array<bigint>")
    found = with_once(df, {"_found": F.transform(points, least_from)}).drop("_halvings")
    return with_once(found, {name: F.transform("_found", tuple_from)}).drop("_found", "_sorted")


def as_text(fingerprint: str) -> Column:
    """16 hexadecimal digits per slot."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def likeness(a: str, b: str) -> Column:
    """Share of equal slots."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return same / F.size(a)


def neighbours(docs: DataFrame, key: str = "doc_id", **rules) -> DataFrame:
    """key, text, fingerprint, and next_text and next_fingerprint of the next row in descending order of key and text; the first follows the last.

    Slices of the key's range come from its quantiles, so no slice holds much
    more than its share. Each slice also gets a copy of the row that follows its
    last one: one row per slice, found by a partial aggregate. Texts move once.
    """
    spark = docs.sparkSession
    slices = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shares = F.array(*[F.lit(i / slices) for i in range(1, slices)])
    bounds = sorted(set(rows.agg(F.percentile_approx("key", shares, 10 * slices)).first()[0] or []))  # one number per slice
    table = F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>")
    slice_of = F.size(F.filter(table, lambda b: b <= F.col("key")))
    rows = rows.select("key", "text", slice_of.alias("slice"), F.lit(False).alias("copy"))
    heads = rows.groupBy("slice").agg(F.max(F.struct("key", "text")).alias("head"))
    up = Window.orderBy(F.col("slice").desc())  # one row per slice
    follows = heads.select("slice", F.coalesce(F.lead("head").over(up), F.first("head").over(up)).alias("head"))
    copies = follows.select("head.key", "head.text", "slice", F.lit(True).alias("copy"))
    made = with_fingerprint(rows.unionByName(copies), "text", "fingerprint", **rules)
    own = Window.partitionBy("slice").orderBy("copy", F.col("key").desc_nulls_last(), F.col("text").desc())
    following = F.lead(F.struct("text", "fingerprint")).over(own)
    return made.withColumn("_next", following).filter(~F.col("copy")).select(
        F.col("key").alias(key), "text", "fingerprint", F.col("_next.text").alias("next_text"), F.col("_next.fingerprint").alias("next_fingerprint")
    )
