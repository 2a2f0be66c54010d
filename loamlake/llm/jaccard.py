"""Jaccard join on word shingles by vertical partitioning, and its components.

All shingles have one global order, rare ones first; it is cut into fragments of
equal weight. A set's first few shingles are indexed: two sets that are similar
enough share one of them. A candidate pair is first held against the parities of its sets:
the universe of shingles is dealt over the bits of a sketch, a bit says whether the set has an odd number
of its shingles, and bits that differ are no more than shingles that differ. What this leaves open
is counted: the overlap in each fragment by itself, then summed.

Equal sets are one class from the start, so copies cost nothing. Inside the sets
that share an indexed shingle not all pairs are made: each round compares a few
pivots with the rest, joins what is similar, and leaves out pairs that are already in
one component and pivots that have met everyone. The first pivots are the sets with the fewest shingles
rarer than the shared one: the text that near copies were made from comes before them and joins them at once. Of two
sets the smaller, if they are similar, shares one of its very first shingles, so only those are pivots. Rounds go on until no pair is open, so no link
between different components is lost.

The order comes from shingle counts over all documents in ``BINS`` hash bins: a
fixed number of counts, whose inexactness moves work but no result.
Shingles are 64-bit hashes, classes 128-bit ones.

Cases: null and empty texts and those without words have an empty set and are linked with nothing; a
text of fewer words than a shingle is one shingle; repeated rows are copies; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamlake.llm.blocks import U, blocks, fetched, mix, send, word_hashes
from loamlake.llm.components import components
from loamlake.runtime import cut_lineage, forget

BINS = 1 << 18
NO_KEY = -(1 << 63)
FEW = 20_000


def shingle_sets(texts, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of every ``k`` words in a row, per text."""
    words, counts, *_ = word_hashes(texts)
    rolled = np.zeros(max(len(words) - k + 1, 0), U)
    for j in range(k):
        rolled = mix(rolled * U(0x100000001B3) + words[j : len(words) - k + 1 + j]) if len(rolled) else rolled
    out, at = [], 0
    for n in counts.tolist():
        if n >= k:
            out.append(np.unique(rolled[at : at + n - k + 1]))
        elif n:
            short = U(n)
            for w in words[at : at + n]:
                short = mix(np.array([short * U(0x100000001B3) + w], U))[0]
            out.append(np.array([short], U))
        else:
            out.append(np.zeros(0, U))
        at += n
    return out


def parities(tokens: np.ndarray) -> np.ndarray:
    """Bits, in 64-bit words: whether the set has an odd number of the shingles dealt to each; as many bits as shingles, up to a power of two."""
    width = max(64, 1 << max(len(tokens) - 1, 0).bit_length())
    odd = np.bincount(((tokens >> U(20)) & U(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def class_of(tokens: np.ndarray) -> bytes:
    """128-bit name of a set."""
    return np.array([mix(tokens ^ U(c)).sum(dtype=U) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F)], U).tobytes()


def jaccard_components(docs: DataFrame, *, key: str = "doc_id", k: int = 3, percent: int = 90, fragments: int = 8) -> DataFrame:
    """key, text_hash, n_shingles, component (the least key reachable by links of at least ``percent``) of every row of ``docs``."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.xxhash64(text).alias("of_text"), text.alias("text"))

    def classes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BINS, np.int64)
        with np.errstate(over="ignore"):
            for frame in blocks(frames, 1 << 18):
                sets = shingle_sets(frame["text"], k)
                total += np.bincount((np.concatenate(sets) & U(BINS - 1)).astype(np.int64), minlength=BINS)
                yield pd.DataFrame({"key": frame["key"].array, "of_text": frame["of_text"].array, "n": [len(s) for s in sets], "cls": [class_of(s) for s in sets]}).assign(bin=None, weight=None)
        bins = np.flatnonzero(total)
        yield pd.DataFrame({"key": None, "of_text": None, "n": None, "cls": None, "bin": bins, "weight": total[bins]})

    first = cut_lineage(rows.mapInPandas(classes, "key bigint, of_text bigint, n int, cls binary, bin int, weight bigint"), "classes")
    members = first.filter("bin IS NULL").select("key", "of_text", "n", "cls")
    weights = fetched(first.filter("bin IS NOT NULL").groupBy("bin").agg(F.sum("weight").alias("weight")))  # BINS numbers
    weight = np.zeros(BINS, np.int64)
    weight[weights["bin"].to_numpy(np.int64)] = weights["weight"].to_numpy(np.int64)
    order = np.argsort(weight, kind="stable")
    rank = np.empty(BINS, np.int32)
    rank[order] = np.arange(BINS)
    share = np.cumsum(weight[order]) / max(weight.sum(), 1)
    fragment = np.empty(BINS, np.int8)
    fragment[order] = np.minimum((share * fragments).astype(np.int8), fragments - 1)
    sent = send(spark, (rank, fragment))  # BINS numbers each

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Two kinds of rows: a class and one of its first shingles; a class and its parities."""
        rank, _ = sent()
        seen = set()  # copies in one task are indexed once
        with np.errstate(over="ignore"):
            for frame in blocks(frames, 1 << 18):
                tokens, names, sizes, places, sketches = [], [], [], [], []
                for s in shingle_sets(frame["text"], k):
                    name = class_of(s)
                    if not len(s) or name in seen:
                        continue
                    seen.add(name)
                    bins = (s & U(BINS - 1)).astype(np.int64)
                    n = len(s) + (-len(s) * percent // 100) + 1  # less what must overlap at least, plus one
                    kept = s[np.lexsort((s, rank[bins]))[:n]]
                    tokens.append(kept.view(np.int64))
                    names += [name] * len(kept)
                    sizes += [len(s)] * len(kept)
                    places.append(np.arange(len(kept), dtype=np.int32))
                    sketches.append((name, parities(s)))
                if tokens:
                    yield pd.DataFrame({"token": np.concatenate(tokens), "cls": names, "n": np.array(sizes, np.int32), "place": np.concatenate(places), "bits": None})
                    yield pd.DataFrame(sketches, columns=["cls", "bits"]).assign(token=None, n=None, place=None)

    bucket = Window.partitionBy("token")
    both = cut_lineage(rows.mapInPandas(index, "token bigint, cls binary, n int, place int, bits array<bigint>"), "index")
    indexed = both.filter("bits IS NULL").select("token", "cls", "n", "place")
    shared_by = indexed.withColumns({"_low": F.min("cls").over(bucket), "_high": F.max("cls").over(bucket)})
    open_rows = cut_lineage(shared_by.filter("_low < _high").select("token", "cls", "n", "place", F.col("cls").alias("comp")).distinct(), "open")
    sketches = both.filter("bits IS NOT NULL").select("cls", "bits").dropDuplicates(["cls"])
    sketches = cut_lineage(sketches.join(open_rows.select("cls").distinct(), "cls", "left_semi"), "sketches")
    forget(both)

    def cut_sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, fragment = sent()
        with np.errstate(over="ignore"):
            for frame in blocks(frames, 1 << 18):
                out = []
                for name, s in zip(frame["cls"], shingle_sets(frame["text"], k)):
                    part = fragment[(s & U(BINS - 1)).astype(np.int64)]
                    by = np.argsort(part, kind="stable")
                    ends = np.searchsorted(part[by], np.arange(fragments + 1))
                    out += [(name, f, s[by[b:e]].view(np.int64)) for f, (b, e) in enumerate(zip(ends[:-1], ends[1:])) if e > b]
                yield pd.DataFrame(out, columns=["cls", "fragment", "tokens"])

    def possible(pairs: DataFrame) -> DataFrame:
        """Of (a, b, na, nb) those whose parities differ in few enough bits; never fewer than are similar."""
        for side in ("a", "b"):
            pairs = pairs.join(sketches.select(F.col("cls").alias(side), F.col("bits").alias(f"s{side}")), side)
        xor = lambda x, y: x.bitwiseXOR(y)
        size = F.least(F.size("sa"), F.size("sb"))
        # Sets of similar sizes have sketches of one width or of neighbouring ones; the wider is folded.
        folded = [F.when(F.size(c) > size, F.zip_with(F.slice(c, F.lit(1), size), F.slice(c, size + 1, size), xor)).otherwise(F.col(c)) for c in ("sa", "sb")]
        differ = F.aggregate(F.zip_with(*folded, lambda x, y: F.bit_count(xor(x, y))), F.lit(0), lambda t, x: t + x)
        both = F.col("na") + F.col("nb")
        return pairs.filter((100 + percent) * differ <= (100 - percent) * both).select("a", "b", "na", "nb")

    def verified(pairs: DataFrame) -> DataFrame:
        """Of (a, b, na, nb) those similar enough: partial overlaps by fragment, summed by pair."""
        # One text of each class in a pair; its fragments meet the pairs of their class.
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
        chosen = members.join(wanted, "cls", "left_semi").groupBy("cls").agg(F.min(F.struct("key", "of_text")).alias("first"))
        chosen = chosen.select("cls", F.col("first.of_text").alias("of_text"), F.coalesce("first.key", F.lit(NO_KEY)).alias("at"))
        chosen = cut_lineage(chosen, "chosen")
        few = chosen.count() <= FEW  # then a broadcast of bounded size spares the shuffle of all texts
        texts = rows.select(F.coalesce("key", F.lit(NO_KEY)).alias("at"), "of_text", "text").join(F.broadcast(chosen) if few else chosen, ["at", "of_text"]).dropDuplicates(["at", "of_text"])
        pieces = cut_lineage(texts.mapInPandas(cut_sets, "cls binary, fragment int, tokens array<bigint>"), "fragments")
        left = pieces.select(F.col("cls").alias("a"), "fragment", F.col("tokens").alias("ta"))
        right = pieces.select(F.col("cls").alias("b"), "fragment", F.col("tokens").alias("tb"))
        partial = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).alias("overlap"))
        total = partial.groupBy("a", "b", "na", "nb").agg(F.sum("overlap").alias("overlap"))
        similar = cut_lineage(total.filter(enough(F.col("overlap"), F.col("na"), F.col("nb"))).select("a", "b"), "links")
        forget(chosen, pieces)
        return similar

    def enough(overlap, na, nb):
        return (100 + percent) * overlap >= percent * (na + nb)

    # Of similar sets the smaller has, so early, a shingle they share: its overlap must be what two sets of its size need, or more.
    early = enough(F.col("n") - F.col("place"), F.col("n"), F.col("n"))
    links, most = None, 2
    while not open_rows.isEmpty():
        # Pivots: early members, those of small components first, then those of few rarer shingles; everyone else in the bucket meets them.
        of_comp = F.count("*").over(Window.partitionBy("token", "comp"))
        nth = F.row_number().over(bucket.orderBy(~early, "_size", "place", F.xxhash64("cls"), "cls"))
        ranked = open_rows.withColumn("_size", of_comp if links is not None else F.lit(1)).withColumn("nth", nth).drop("_size")
        pivots = ranked.filter(early & (F.col("nth") <= most)).select("token", *[F.col(c).alias(f"p{c}") for c in ("cls", "n", "place", "comp", "nth")])
        met = ranked.join(pivots, "token").filter("nth > pnth AND comp <> pcomp")
        # If the shared shingle is the first one of both, the overlap is at most what follows it; the pair meets there if nowhere else.
        rest = F.least(F.col("n") - F.col("place"), F.col("pn") - F.col("pplace"))
        met = met.filter((100 * F.least("n", "pn") >= percent * F.greatest("n", "pn")) & enough(rest, F.col("n"), F.col("pn")))
        first_is = F.col("cls") < F.col("pcls")
        pairs = met.select(
            F.least("cls", "pcls").alias("a"), F.greatest("cls", "pcls").alias("b"),
            F.when(first_is, F.col("n")).otherwise(F.col("pn")).alias("na"), F.when(first_is, F.col("pn")).otherwise(F.col("n")).alias("nb"),
        )
        pairs = cut_lineage(possible(pairs.distinct()), "pairs")
        found = verified(pairs) if not pairs.isEmpty() else None
        forget(pairs)
        if found is not None:
            links = found if links is None else links.unionByName(found)
        apart = {"_low": F.min("comp").over(bucket), "_high": F.max("comp").over(bucket), "_early": F.max(early).over(bucket)}
        still_open = lambda df: cut_lineage(df.withColumns(apart).filter("_low < _high AND _early").drop(*apart), "open")  # noqa: B023, E731
        left_over = still_open(ranked.filter(F.col("nth") > most).drop("nth"))
        if found is not None and not left_over.isEmpty():
            comp = open_rows.select("cls", "comp").distinct()
            ends = found.join(comp.select(F.col("cls").alias("a"), F.col("comp").alias("ca")), "a").join(comp.select(F.col("cls").alias("b"), F.col("comp").alias("cb")), "b")
            renamed = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("comp"), "component")
            left_over = still_open(left_over.join(renamed, "comp", "left").select("token", "cls", "n", "place", F.coalesce("component", "comp").alias("comp")))
        open_rows, most = left_over, 8 * most

    named = members.filter("n > 0").groupBy("cls").agg(F.min("key").alias("least"))
    if links is not None:
        named = named.join(components(links).select(F.col("node").alias("cls"), "component"), "cls", "left")
        whole = named.withColumn("component", F.coalesce("component", "cls"))
        least = whole.groupBy("component").agg(F.min("least").alias("least"))
        named = whole.select("cls", "component").join(least, "component").select("cls", "least")
    named = named.withColumnRenamed("least", "component")
    joined = members.join(named, "cls", "left")
    return joined.select(F.col("key").alias(key), F.col("of_text").alias("text_hash"), F.col("n").cast("bigint").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("key")).alias("component"))


def keep_one(docs: DataFrame, *, key: str = "doc_id", **rules) -> DataFrame:
    """``docs`` with one row of each component: that with the least key (null last), then the least text hash.

    Rows without a shingle are linked with nothing and all stay.
    """
    found = jaccard_components(docs.select(key, "text"), key=key, **rules).filter("n_shingles > 0")
    one = found.groupBy("component").agg(F.min(F.struct(F.col(key).isNull(), F.col(key).alias("at"), "text_hash")).alias("one"))
    one = one.select(F.coalesce("one.at", F.lit(NO_KEY)).alias("_at"), F.col("one.text_hash").alias("_hash"))
    out = found.select(F.coalesce(key, F.lit(NO_KEY)).alias("_at"), F.col("text_hash").alias("_hash")).distinct().join(one, ["_at", "_hash"], "left_anti")
    names = [f"_c{i}" for i in range(len(docs.columns))]
    rows = docs.select(
        *[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)], F.coalesce(F.col(key).cast("bigint"), F.lit(NO_KEY)).alias("_at"), F.xxhash64(F.col("text").cast("string")).alias("_hash"),
        (F.trim(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "\t\n\x0b\x0c\r", "     ")) == "").alias("_none"),
    )
    left = rows.join(out, ["_at", "_hash"], "left_anti")
    again = F.row_number().over(Window.partitionBy("_at", "_hash").orderBy("_at"))
    return left.withColumn("_again", again).filter("_again = 1 OR _none").select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)])
