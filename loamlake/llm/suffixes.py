"""Repeated strings of a corpus, found by merged Burrows-Wheeler orders of aligned contexts.

Every string of ``length`` bytes holds an anchor: the place whose ``GRAM``-byte
hash is least in it. Equal strings have their anchor at the same place, so only
contexts around anchors with equal hashes can hold equal strings; a context is
the strings whose anchor it is. Grams that are frequent in the corpus (counted over all texts in
``BINS`` bins) become anchors only of strings made of such grams, so a common line gathers
equal contexts, which are one, and no others. Each group of
such contexts is a collection of shards, in the order they come. Its positional
Burrows-Wheeler order starts as the shards one after another and is refined
column by column: a stable counting step by the next byte interleaves the shards
anew, suffixes are never sorted again. The divergence kept with it is the
common prefix length between neighbours; where it reaches ``length`` an interval of the order is a
repeated string.

Texts are known by 128-bit hashes: copies are handled once, and any string in a text
that occurs as two rows is repeated. A text moves twice: to meet its anchors and to meet its spans.

Cases: a null text is empty; texts shorter than ``length`` keep all bytes; repeated rows lose all their
strings of that length; overlaps inside one text count; spans that touch are one; an empty table gives an
empty result; other columns are ignored or passed on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamlake.llm.blocks import U, blocks, fetched, joined, prefix_hash, range_hash, send, spans
from loamlake.runtime import cut_lineage, forget

GRAM = 32
BINS = 1 << 16
# Characters whose grams are worked on at once: a task holds some dozen numbers for each.
BLOCK = 1 << 18


def sliding(op, x: np.ndarray, width: int) -> np.ndarray:
    """op over x[i : i + width] for every i; the tail is cut off."""
    have = 1
    while 2 * have <= width:
        x = op(x[:-have], x[have:])
        have *= 2
    return op(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def gram_counts(texts) -> np.ndarray:
    """Grams of the texts in BINS bins of their hash."""
    data, first, last = joined(texts)
    at = np.flatnonzero(np.repeat(last - GRAM, last - first + 1) >= np.arange(len(data)))
    return np.bincount((range_hash(prefix_hash(data), at, at + GRAM) & U(BINS - 1)).astype(np.int64), minlength=BINS)


def anchors(texts, length: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, place) of the least gram of every string of ``length`` bytes; grams of ``frequent`` bins are the greatest.

    A place is a byte number, how far before it the first of those strings begins and how far before it the last, in one number.
    """
    data, first, last = joined(texts)
    none = (np.zeros(0, np.int64),) * 3
    if len(data) < length or not len(first):
        return none
    at = np.arange(len(data) - GRAM + 1)
    hashes = range_hash(prefix_hash(data), at, at + GRAM)
    hashes = hashes >> U(1) | frequent[(hashes & U(BINS - 1)).astype(np.int64)].astype(U) << U(63)
    doc = np.repeat(np.arange(len(first)), last - first + 1)
    width = length - GRAM + 1
    inside = np.arange(len(hashes) - width + 1)
    least = np.where(inside + length <= last[doc[: len(inside)]], sliding(np.minimum, hashes, width), U(0))
    # A gram is an anchor if it is the least of some string it lies in.
    pad = np.zeros(width - 1, U)
    most = sliding(np.maximum, np.concatenate([pad, least, pad]), width)[: len(hashes)]
    picked = np.flatnonzero((hashes == most) & (most > 0))
    value, far, near = hashes[picked], np.zeros(len(picked), np.int64), np.full(len(picked), -1, np.int64)
    for back in range(width):
        begin = picked - back
        mine = (begin >= 0) & (begin < len(least))
        mine[mine] = least[begin[mine]] == value[mine]
        far[mine] = back
        near[mine & (near < 0)] = back
    return value.view(np.int64), doc[picked], (picked - first[doc[picked]]) << 20 | far << 10 | near


def contexts(data: bytes, places: list[int], length: int) -> list[tuple[int, int, bytes]]:
    """(byte number, bytes before it, context) of each anchor: the strings of ``length`` whose least gram it is."""
    out = []
    for place in places:
        pos, far, near = place >> 20, place >> 10 & 1023, place & 1023
        out.append((pos, far, data[pos - far : pos - near + length]))
    return out


def repeated_windows(columns: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Which strings of ``length`` (contexts x window starts) also stand in another context of their group.

    ``columns``: contexts x bytes, 256 outside the text; contexts of a group stand together.
    """
    n, width = columns.shape
    found = np.zeros((n, width - length + 1), bool)
    order = np.arange(n)
    start = np.zeros(n + 1, np.int32)  # where the match with the neighbour before begins; one spare
    fresh = np.ones(n, bool)
    fresh[1:] = group[1:] != group[:-1]
    start[:-1][fresh] = 1
    by_column = np.ascontiguousarray(columns.T)
    base = group.astype(np.int64) << 9
    for k in range(width):
        byte = by_column[k][order]
        key = base[order] + byte
        step = np.argsort(key, kind="stable")
        key = key[step]
        reach = np.maximum.reduceat(start, step + 1)
        new = np.full(n + 1, k + 1, np.int32)
        same = (key[1:] == key[:-1]) & (byte[step][1:] < 256)
        new[1:-1][same] = reach[:-1][same]
        order, start = order[step], new
        if k + 1 >= length:
            long = k + 1 - start[:-1] >= length
            long[:-1] |= long[1:]
            found[order[long], k + 1 - length] = True
    return found


def _spans_of(batch: pd.DataFrame, length: int) -> pd.DataFrame:
    """(h, begin, end) of the repeated strings in complete groups of contexts."""
    side = length - GRAM
    # Contexts that are equal are one; at several places, all their strings are repeated.
    number = batch.groupby(["fp", "lead", "context"], sort=False).ngroup().to_numpy()
    size = np.bincount(number, weights=batch["pos"].map(len))
    one = np.zeros(len(size), np.int64)
    one[number[::-1]] = np.arange(len(batch))[::-1]
    group = batch["fp"].to_numpy()[one]
    by = np.argsort(group, kind="stable")
    _, group_number, members = np.unique(group[by], return_inverse=True, return_counts=True)
    meet = (members[group_number] > 1) | (size[by] > 1)
    by, group_number = by[meet], group_number[meet]
    if not len(by):
        return pd.DataFrame({"h": pd.Series([], dtype=object), "begin": [], "end": []})
    lead, texts = batch["lead"].to_numpy(), batch["context"].to_numpy()
    columns = np.full((len(by), side + length), 256, np.uint16)
    for row, i in enumerate(one[by].tolist()):
        columns[row, side - lead[i] : side - lead[i] + len(texts[i])] = np.frombuffer(texts[i], np.uint8)
    found = repeated_windows(columns, group_number, length)
    for row in np.flatnonzero(size[by] > 1).tolist():
        i = one[by[row]]
        found[row, side - lead[i] : side - lead[i] + len(texts[i]) - length + 1] = True
    place = np.full(len(size), -1, np.int64)
    place[by] = np.arange(len(by))
    rows = np.flatnonzero(place[number] >= 0)
    flat = np.zeros((len(rows), found.shape[1] + 1), bool)
    flat[:, :-1] = found[place[number[rows]]]
    start, stop = spans(flat.ravel())
    row, start, run = start // flat.shape[1], start % flat.shape[1], stop - start
    row = rows[row]
    made = pd.DataFrame({"h": batch["h"].to_numpy()[row], "pos": batch["pos"].to_numpy()[row], "start": start, "run": run})
    made = made.explode(["h", "pos"], ignore_index=True)
    begin = made["pos"].astype(np.int64) - side + made["start"]
    return pd.DataFrame({"h": made["h"], "begin": begin, "end": begin + made["run"] - 1 + length})


def with_hash(docs: DataFrame) -> DataFrame:
    """Adds ``_text`` (null as empty) and ``_h``, its 128-bit hash."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumns({"_text": text, "_h": F.unhex(F.md5(text.cast("binary")))})


def repeated_spans(docs: DataFrame, length: int = 200, batch_rows: int = 8192) -> DataFrame:
    """(h, spans): per distinct text with repeated strings the sorted arrays of begin and end bytes; a null array: all of it.

    ``length`` must exceed GRAM and stay below GRAM + 1024. A group of contexts is worked on by one task, distinct contexts in one order.
    """
    rows = with_hash(docs.select("text")).select(F.col("_h").alias("h"), F.col("_text").alias("text"))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BINS, np.int64)
        for frame in blocks(frames, BLOCK):
            total += gram_counts(frame["text"])
        bins = np.flatnonzero(total)
        yield pd.DataFrame({"bin": bins, "n": total[bins]})

    counts = fetched(rows.select("text").mapInPandas(count, "bin int, n bigint").groupBy("bin").agg(F.sum("n").alias("n")))  # BINS numbers
    frequent = np.zeros(BINS, bool)
    frequent[counts["bin"].to_numpy(np.int64)[counts["n"].to_numpy() > 16 * counts["n"].sum() / BINS]] = True
    sent = send(docs.sparkSession, frequent)

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequent, seen = sent(), set()  # copies in one task are read once
        for frame in blocks(frames, BLOCK):
            frame = frame[[h not in seen and not seen.add(h) for h in frame["h"]]]
            fp, doc, place = anchors(frame["text"], length, frequent)
            yield pd.DataFrame({"fp": fp, "h": frame["h"].to_numpy()[doc], "place": place})

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row per distinct context of a block of texts, with all its places there."""
        seen = set()
        for frame in blocks(frames, 1 << 19):
            found: dict[tuple, tuple[list, list]] = {}
            for h, text, anchored in zip(frame["h"], frame["text"], frame["places"]):
                if h in seen:
                    continue
                seen.add(h)
                data = text.encode("utf-8", "surrogatepass")
                fps, places = [a["fp"] for a in anchored], [a["place"] for a in anchored]
                for fp, (pos, lead, context) in zip(fps, contexts(data, places, length)):
                    texts, at = found.setdefault((fp, lead, context), ([], []))
                    texts.append(h)
                    at.append(pos)
            if found:
                made = pd.DataFrame(list(found), columns=["fp", "lead", "context"])
                yield made.assign(h=[v[0] for v in found.values()], pos=[v[1] for v in found.values()])

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        count = 0
        for frame in frames:
            held.append(frame)
            count += len(frame)
            if count >= batch_rows:
                every = pd.concat(held, ignore_index=True)
                last = every["fp"].iloc[-1]
                done = every["fp"].to_numpy() != last  # groups stand together
                if done.any():
                    yield _spans_of(every[done].reset_index(drop=True), length)
                held = [every[~done]]
                count = len(held[0])
        if count:
            yield _spans_of(pd.concat(held, ignore_index=True), length)

    bucket = Window.partitionBy("fp")
    places = rows.mapInPandas(find, "fp bigint, h binary, place bigint").withColumn("_n", F.count("*").over(bucket)).filter("_n > 1")
    # Anchors of one text: no more than its length has.
    by_text = cut_lineage(places.groupBy("h").agg(F.sort_array(F.collect_set(F.struct("place", "fp"))).alias("places")), "places")
    around = rows.join(by_text, "h").mapInPandas(cut, "fp bigint, lead int, context binary, h array<binary>, pos array<bigint>")
    # A place that two tasks give belongs to a text of several rows, all of whose strings are repeated.
    found = around.repartition("fp").sortWithinPartitions("fp").mapInPandas(compare, "h binary, begin bigint, end bigint")
    spans_by_text = found.groupBy("h").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("spans"))
    copies = rows.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h", F.lit(True).alias("copied"))
    both = copies.join(spans_by_text, "h", "full")
    spans_made = cut_lineage(both.select("h", F.when(F.col("copied"), F.lit(None)).otherwise(F.col("spans")).alias("spans"), F.coalesce("copied", F.lit(False)).alias("copied")), "spans")
    forget(by_text)
    return spans_made


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted spans as maximal runs; spans that touch are one."""
    if not len(begin):
        return begin, end
    reach = np.maximum.accumulate(end)
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > reach[:-1]
    stops = np.flatnonzero(np.append(new[1:], True))
    return begin[new], reach[stops]


def spans_in(size: int, found, copied, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte runs to remove of one text of ``size`` bytes."""
    if copied is True or copied is np.True_:
        return (np.array([0]), np.array([size])) if size >= length else (np.zeros(0, int), np.zeros(0, int))
    if found is None or not len(found):
        return np.zeros(0, int), np.zeros(0, int)
    pairs = np.array([(s["begin"], s["end"]) for s in found])
    return merged(pairs[:, 0], pairs[:, 1])


def kept_bytes(data: bytes, begin: np.ndarray, end: np.ndarray) -> bytes:
    starts, stops = [0, *end.tolist()], [*begin.tolist(), len(data)]
    return b"".join(data[s:e] for s, e in zip(starts, stops))


def with_spans(docs: DataFrame, length: int = 200) -> DataFrame:
    """``docs`` with ``_text``, ``_h``, ``_spans`` and ``_copied``."""
    found = repeated_spans(docs, length).select(F.col("h").alias("_h"), F.col("spans").alias("_spans"), F.col("copied").alias("_copied"))
    return with_hash(docs).join(found, "_h", "left")


def digests(docs: DataFrame, key: str = "doc_id", length: int = 200) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 of every row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text, found, copied in zip(frame["_text"], frame["_spans"], frame["_copied"]):
                data = text.encode("utf-8", "surrogatepass")
                begin, end = spans_in(len(data), found, copied, length)
                kept = kept_bytes(data, begin, end)
                rows.append((len(data), len(data) - len(kept), len(begin), hashlib.sha256(kept).hexdigest()))
            made = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"], index=frame.index)
            yield pd.concat([frame[["_key"]], made], axis=1)

    rows = with_spans(docs.select(F.col(key).alias("_key"), "text"), length).select("_key", "_text", "_spans", "_copied")
    schema = f"_key {docs.schema[key].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return rows.mapInPandas(run, schema).withColumnRenamed("_key", key)


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """``docs`` with the repeated strings cut out of ``text``, whole characters only; null texts stay null."""
    kept = [c for c in docs.columns if c != "text"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = []
            for text, whole, found, copied in zip(frame["text"], frame["_text"], frame["_spans"], frame["_copied"]):
                data = whole.encode("utf-8", "surrogatepass")
                begin, end = spans_in(len(data), found, copied, length)
                if not len(begin):
                    texts.append(text)
                    continue
                inner = (np.frombuffer(data, np.uint8) & 0xC0) == 0x80  # bytes inside a character
                inner = np.append(inner, False)
                while inner[begin].any():
                    begin = begin + inner[begin]
                while inner[end].any():
                    end = end - inner[end]
                texts.append(kept_bytes(data, begin, end).decode("utf-8", "surrogatepass"))
            yield frame.assign(text=texts)[["text", *[f"_c{i}" for i in range(len(kept))]]]

    renamed = docs.select("text", *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(kept)])
    rows = with_spans(renamed, length).drop("_h")
    types = {f.name: f.dataType.simpleString() for f in renamed.schema}
    made = rows.mapInPandas(run, "text string, " + ", ".join(f"_c{i} {types[f'_c{i}']}" for i in range(len(kept)))) if kept else rows.mapInPandas(run, "text string")
    return made.select(*[F.col("text") if c == "text" else F.col(f"_c{kept.index(c)}").alias(c) for c in docs.columns])
