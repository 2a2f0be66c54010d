"""License scan by diagonal voting.

All rolling hashes of k words are joined to their places in short templates.
A hit votes for the diagonal (place in the text less place in the template);
votes are summed per diagonal, neighbouring diagonals (words put in or left out)
are merged. A merged span is then held against its template: only hits that follow each
other in both, with at most ``gap`` words put in or left out between two, count, each place of the template once;
enough of its places must be met, and the words that tell licenses or versions apart stand whole.
All k-grams of a phrase on one diagonal are the phrase, word for word.

The templates are a short list in the code, so they alone are broadcast. Votes
are summed where the words are read; only texts' sums and diagonals move.

Cases: null and empty texts have no word and no label; a text shorter than a
phrase has none; repeated rows are scanned one by one; the same label from several
places is named once; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamlake.operators.once import with_once

K = 3
# Phrases whose places are reported, by label.
BASE = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
# Openings of common licenses, as their publishers word them.
TEXTS = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"),
    *[("cc-by", f"licensed under a creative commons attribution {v} license") for v in ("4 0 international", "3 0 unported", "2 5 generic", "2 0 generic")],
    ("all-rights-reserved", "all rights reserved no part of this may be reproduced in any form without permission"),
]

# Words that tell licenses and versions apart: one of each group must stand whole.
TELLING = {"gpl-3": [["gnu general"], ["version 3"]], "apache-2": [["version 2"]], "cc-by": [[f"attribution {v}" for v in "432"]]}


def word_array(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, runs of digits, letters and characters beyond ASCII."""
    # The one character beyond ASCII whose lower case is an ASCII letter must stay what it is.
    lowered = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\ufffd")))
    return F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def gram_hashes(words: Column, k: int = K) -> Column:
    """Hash of every ``k`` words in a row."""
    one = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(0), F.size(words) - k), one)).otherwise(F.array().cast("array<bigint>"))


def template_places(spark, k: int = K) -> DataFrame:
    """(hash, template, label, base, place, grams, telling) of all templates; ``telling`` has the bits of the places of each group of telling words."""
    rows = []
    for i, (label, text) in enumerate([*BASE, *TEXTS]):
        words = text.split()
        parts = [f" {' '.join(words[p : p + k])} " for p in range(len(words) - k + 1)]
        if len(parts) > 63:
            raise ValueError("templates: 63 k-grams at most")
        groups = [] if i < len(BASE) else TELLING.get(label, [])
        telling = [sum(1 << p for p, part in enumerate(parts) if any(f" {t} " in part for t in group)) for group in groups]
        rows.append((i, label, i < len(BASE), words, telling))
    words = spark.createDataFrame(rows, "template int, label string, base boolean, words array<string>, telling array<bigint>")
    grams = words.withColumn("grams", F.size("words") - (k - 1))
    return grams.select("template", "label", "base", "grams", "telling", F.posexplode(gram_hashes(F.col("words"), k)).alias("place", "hash"))


def diagonals(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row per text and diagonal with votes (a row without template for the rest of a text): row, key, n_words, template, label, base, grams, telling, diagonal, votes, places (as bits)."""
    once = with_once(docs.select(key, F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text")), {"words": word_array(F.col("text"))})
    rows = once.select("row", key, F.size("words").cast("bigint").alias("n_words"), gram_hashes(F.col("words")).alias("hashes"))
    grams = rows.select("row", key, "n_words", F.posexplode_outer("hashes").alias("pos", "hash"))
    places = F.broadcast(template_places(docs.sparkSession))  # a list in this module
    met = grams.join(places, "hash", "left")
    diagonal = (F.col("pos") - F.col("place")).cast("bigint")
    return met.groupBy("row", key, "n_words", "template", "label", "base", "grams", "telling", diagonal.alias("diagonal")).agg(
        F.count("template").alias("votes"), F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("place"))).alias("places")
    )


def in_order(lines: str, grams: str, telling: str, gap: int) -> Column:
    """Struct of any and sure: the most places met in order (size, start, words told apart or not); ``sure`` only of those with all telling words.

    ``lines`` are a band's (diagonal, places). Hits are taken in text order; the longest row of hits is kept for each place it may end at.
    """
    big = lambda x: F.lit(x).cast("bigint")
    bit = lambda place: F.call_function("shiftleft", big(1), place)
    top = lambda size, start: F.struct(size.alias("size"), start.alias("start"))
    row = lambda size, diagonal, start, mask: F.struct(size.alias("size"), diagonal.alias("diagonal"), start.alias("start"), mask.alias("mask"))
    places = F.sequence(F.lit(0), F.col(grams).cast("int") - 1)
    of_line = lambda line: F.transform(
        F.filter(places, lambda p: line["places"].bitwiseAND(bit(p)) != 0), lambda p: F.struct((line["diagonal"] + p).alias("pos"), p.alias("place"), line["diagonal"].alias("diagonal"))
    )
    hits = F.array_sort(F.flatten(F.transform(lines, of_line)))

    def step(held, hit):
        fits = lambda c, q: (q < hit["place"]) & (c["size"] > 0) & (c["diagonal"] + q < hit["pos"]) & (F.abs(c["diagonal"] - hit["diagonal"]) <= gap)
        best = F.array_max(F.filter(held["rows"], fits))
        new = row(F.coalesce(best["size"], big(0)) + 1, hit["diagonal"], F.coalesce(best["start"], hit["diagonal"]), F.coalesce(best["mask"], big(0)).bitwiseOR(bit(hit["place"])))
        return F.get(F.transform(F.array(new), lambda n: put(held, hit, n)), 0)

    def put(held, hit, new):
        old_goes = lambda c: (c["size"] <= new["size"]) | (F.abs(c["diagonal"] - hit["diagonal"]) > gap)
        rows = F.transform(held["rows"], lambda c, q: F.when((q == hit["place"]) & old_goes(c), new).otherwise(c))
        now = top(new["size"], new["start"])
        told = F.forall(telling, lambda t: t.bitwiseAND(new["mask"]) != 0)
        better = lambda old: F.when(now["size"] > old["size"], now).otherwise(old)
        return F.struct(rows.alias("rows"), better(held["any"]).alias("any"), F.when(told, better(held["sure"])).otherwise(held["sure"]).alias("sure"))

    none = F.struct(F.transform(places, lambda _: row(big(0), big(0), big(0), big(0))).alias("rows"), top(big(0), big(0)).alias("any"), top(big(0), big(0)).alias("sure"))
    return F.aggregate(hits, none, step, lambda held: F.struct(held["any"].alias("any"), held["sure"].alias("sure")))


def scan(docs: DataFrame, key: str = "doc_id", *, gap: int = 3, share: float = 0.5, least_votes: int = 2) -> DataFrame:
    """Per text: key, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label, start, votes, share)."""
    found = diagonals(docs, key)
    own = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(own) > gap).cast("int"), F.lit(0))
    exact = F.coalesce(F.col("base") & (F.col("votes") == F.col("grams")), F.lit(False))
    merged = (
        found.withColumns({"exact": exact, "step": apart})
        .withColumn("band", F.sum("step").over(own))
        .groupBy("row", key, "n_words", "template", "label", "base", "grams", "telling", "band")
        .agg(
            F.collect_list(F.struct("diagonal", "places")).alias("lines"),
            F.sum(F.col("exact").cast("bigint")).alias("n_base"),
            F.min(F.when(F.col("exact"), F.col("diagonal"))).alias("first_word"),
            F.max(F.when(F.col("exact"), F.col("diagonal"))).alias("last_word"),
        )
    )
    merged = with_once(merged, {"held": F.when(F.col("template").isNotNull(), in_order("lines", "grams", "telling", gap))})
    part = F.coalesce(F.col("held.any.size") / F.col("grams"), F.lit(0.0))
    votes = F.when(F.col("n_base") > 0, F.col("held.any.size")).otherwise(F.col("held.sure.size"))
    start = F.when(F.col("n_base") > 0, F.col("first_word")).otherwise(F.col("held.sure.start"))
    sure = (F.col("n_base") > 0) | (~F.col("base") & (F.col("votes") >= least_votes) & (F.col("votes") / F.col("grams") >= share))
    span = F.struct("label", F.greatest("start", F.lit(0)).alias("start"), "votes", (F.col("votes") / F.col("grams")).alias("share"))
    names = lambda kept: F.array_join(F.array_sort(F.collect_set(F.when(kept, F.col("label")))), ",")
    return (
        merged.withColumns({"part": part, "votes": votes, "start": start})
        .groupBy("row", key, "n_words")
        .agg(
            F.sum("n_base").alias("n_base"),
            F.min("first_word").alias("first_word"),
            F.max("last_word").alias("last_word"),
            names(F.col("n_base") > 0).alias("base_labels"),
            names(sure).alias("labels"),
            F.max("part").alias("score"),
            F.array_sort(F.collect_list(F.when(sure, span))).alias("spans"),
        )
        .drop("row")
    )
