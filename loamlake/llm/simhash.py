"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint bit is one if it is set in over half the XXH64 hashes (seed 42) of a
text's four-word shingles, repeats counted. Two fingerprints link when at most
``radius`` bits differ.

Candidates come from covering masks. Every bit number gets a vector of
``radius + 1`` bits, and every vector v but zero is a table, whose mask has the
bits whose own vector has an odd product with v. At most ``radius`` differing bits span less
than the whole space, so some v is orthogonal to all of them: its mask
leaves them all out, and the two fingerprints have equal masked bits there. No
linked pair is missed, whatever the data.

Copies are one class. A bucket of two classes is a pair of its least and
its greatest member, so counting buckets finds it; larger ones are gathered and searched
breadth first, which emits a spanning forest and not their pairs. A bucket above ``most`` classes is
covered anew over the bits its mask leaves open, with the same guarantee; each such
step about halves those bits, until they alone bound a bucket to 4,096 classes. None is gathered whole before.

Cases: null and empty texts and those without words have fingerprint zero, linked
like any other; fewer words than a shingle are one shingle; repeated rows are copies; a null key is no
component's name unless nothing else is there; a text of any length is hashed a slice of shingles at
a time; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamlake.llm.components import components
from loamlake.operators.skew import lookup
from loamlake.runtime import cut_lineage

SEED = 42
BITS = 64
FREE = 12  # a bucket whose mask leaves so few bits open holds 4,096 classes at most


def fingerprint(text: str, k: int = 4, step: int = 1 << 16) -> int:
    """64-bit SimHash of one text; ``step`` shingles are held at once."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not words:
        return 0
    whole, k = b" ".join(words), min(k, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begin = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1].tolist()
    end = ends[k - 1 :].tolist()
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(begin), step):
        part = [xxhash.xxh64_intdigest(whole[a:b], SEED) for a, b in zip(begin[at : at + step], end[at : at + step])]
        ones += np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(begin), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, *, key: str = "doc_id", k: int = 4) -> DataFrame:
    """key, fingerprint (its 64 bits as a bigint) of every row of ``docs``."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py() or "", k) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["key", "fingerprint"])

    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(made, "key bigint, fingerprint bigint")


def covering_masks(radius: int, taken: int = 0) -> list[int]:
    """Masks over the bits not in ``taken``, together with ``taken``.

    Two numbers that agree in ``taken`` and differ in at most ``radius`` bits agree under one of them.
    """
    free = [b for b in range(BITS) if not taken >> b & 1]
    # Unit vectors first: with so many free bits at least, no mask adds nothing.
    vectors = sorted(range(1, 1 << (radius + 1)), key=lambda v: (v.bit_count(), v))
    vector_of = {b: vectors[i % len(vectors)] for i, b in enumerate(free)}
    return sorted({taken | sum(1 << b for b in free if (vector_of[b] & v).bit_count() & 1) for v in vectors})


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def forest(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the numbers linked at ``radius`` or fewer differing bits, breadth first."""
    waiting, edges = prints.view(np.uint64), []  # counting bits of a negative number would count those of its absolute value
    while len(waiting) > 1:
        front, waiting = [waiting[0]], waiting[1:]
        while front and len(waiting):
            at = front.pop()
            near = np.bitwise_count(waiting ^ at) <= radius
            if near.any():
                found = waiting[near]
                edges += [(int(at.view(np.int64)), int(x)) for x in found.view(np.int64)]
                front += list(found)
                waiting = waiting[~near]
    return edges


def near_pairs(classes: DataFrame, *, radius: int = 4, most: int = 4096) -> DataFrame:
    """a, b: links between the distinct ``fingerprint`` of ``classes`` that connect all that is linked."""
    spark = classes.sparkSession
    masks = [signed(m) for m in covering_masks(radius)]
    rows = classes.select("fingerprint", F.explode(F.array(*[F.lit(m).cast("bigint") for m in masks])).alias("mask"))
    paths, found = [m % (1 << BITS) for m in masks], None

    def linked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            edges = [e for prints in frame["prints"] for e in forest(np.asarray(prints, np.int64), radius)]
            yield pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    while True:
        rows = rows.withColumn("bits", F.col("fingerprint").bitwiseAND(F.col("mask")))
        sized = rows.groupBy("mask", "bits").agg(F.count("*").alias("n"), F.min("fingerprint").alias("a"), F.max("fingerprint").alias("b"))
        buckets = cut_lineage(sized.filter("n > 1"), "buckets")
        pairs = buckets.filter("n = 2").filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("a", "b")
        hot = (F.col("n") > most) & (BITS - F.bit_count("mask") > FREE)
        groups = buckets.filter((F.col("n") > 2) & ~hot).select("mask", "bits")
        gathered = rows.join(groups, ["mask", "bits"]).groupBy("mask", "bits").agg(F.collect_list("fingerprint").alias("prints"))
        links = cut_lineage(pairs.unionByName(gathered.select("prints").mapInPandas(linked, "a bigint, b bigint")).distinct(), "links")
        found = links if found is None else found.unionByName(links)
        large = buckets.filter(hot).select("mask", "bits")
        if large.isEmpty():
            return found
        # Few masks: 31 of the first step, at most 31 times as many in each further one.
        finer = {m: covering_masks(radius, m) for m in paths if BITS - m.bit_count() > FREE}
        table = spark.createDataFrame([(signed(m), signed(f)) for m, made in finer.items() for f in made], "mask bigint, finer bigint")
        again = rows.join(large, ["mask", "bits"]).select("fingerprint", "mask")
        rows = cut_lineage(again.join(F.broadcast(table), "mask").select("fingerprint", F.col("finer").alias("mask")).distinct(), "finer")
        paths = sorted({f for made in finer.values() for f in made})


def near_components(docs: DataFrame, *, key: str = "doc_id", k: int = 4, radius: int = 4) -> DataFrame:
    """key, fingerprint (bigint), component: the least key reachable by links, of every row of ``docs``."""
    prints = cut_lineage(with_fingerprints(docs, key=key, k=k), "prints")
    classes = cut_lineage(prints.groupBy("fingerprint").agg(F.min("key").alias("least")), "classes")
    joined = components(near_pairs(classes, radius=radius)).select(F.col("node").alias("fingerprint"), F.col("component").alias("group"))
    named = classes.join(joined, "fingerprint")
    least = named.groupBy("group").agg(F.min("least").alias("component"))
    of_print = cut_lineage(named.select("fingerprint", "group").join(least, "group").select("fingerprint", "component"), "components")
    alone = classes.join(of_print, "fingerprint", "left_anti").select("fingerprint", F.col("least").alias("component"))
    whole = cut_lineage(of_print.unionByName(alone), "components")
    return lookup(prints, whole, "fingerprint").select(F.col("key").alias(key), "fingerprint", "component")


def as_hex(column: str):
    """16 lowercase hex digits of a bigint."""
    return F.lpad(F.lower(F.hex(F.col(column))), 16, "0")
