"""Packing token ids into windows by Karmarkar-Karp multiway differencing.

A group of documents (about ``group_windows`` windows of ids) is cut into
pieces: full windows first, then pieces of at most ``piece``; the last documents
of a group are cut finer, as small pieces even out what is left. The differencing
starts with every piece as a partition of its own and merges the two with the
largest spread, heaviest part of one onto lightest part of the other, until
one partition of k near-equal windows is left. k starts at the least that the
ids need and rises by one as often as a window exceeds its capacity.

Groups follow the input's partitions, so nothing is shuffled, and a task holds
one group. Cases: a null text is empty and still gives its end id; repeated rows
are packed one by one; a text longer than many windows is cut into them; an
empty table gives no piece; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamlake.llm.blocks import blocks
from loamlake.llm.encoder import encoder


def differencing(sizes: list[int], k: int) -> np.ndarray:
    """The window, 0 to k - 1, of each item; the windows' sums are near-equal.

    A partition is k sums in descending order, less the smallest of them (a load
    that all windows share doesn't count). Merges are written down and read
    backwards at the end, when the windows of the last partition get their numbers.
    """
    zero = np.zeros(k, np.int64)
    heap = []
    for i, size in enumerate(sizes):
        sums = zero.copy()
        sums[0] = size
        heap.append((-size if k > 1 else 0, i, sums))
    heapq.heapify(heap)
    merges = []
    while len(heap) > 1:
        _, a, own = heapq.heappop(heap)
        _, b, other = heapq.heappop(heap)
        sums = own + other[::-1]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        sums -= sums[-1]
        number = len(sizes) + len(merges)
        merges.append((a, b, order))
        heapq.heappush(heap, (-int(sums[0]), number, sums))
    at: dict[int, np.ndarray] = {heap[0][1]: np.arange(k)} if heap else {}
    for number in range(len(sizes) + len(merges) - 1, len(sizes) - 1, -1):
        a, b, order = merges[number - len(sizes)]
        names = at.pop(number)
        mine = np.empty(k, np.int64)
        mine[order] = names
        at[a], at[b] = mine, mine[::-1]
    return np.fromiter((at[i][0] for i in range(len(sizes))), np.int64, len(sizes))


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """The items of each window: the fewest windows, from the least the sizes need, that differencing fills within ``capacity``."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        place = differencing(sizes, k)
        loads = np.bincount(place, weights=sizes, minlength=k) if sizes else np.zeros(k)
        if loads.max() <= capacity:
            order = np.argsort(place, kind="stable")
            return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(place[order])) + 1) if len(x)]
        k += 1


def pieces(length: int, capacity: int, piece: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full windows, then equal parts of the rest up to ``piece``."""
    full = length // capacity
    out = [(i * capacity, capacity) for i in range(full)]
    start, rest = full * capacity, length % capacity
    n = -(-rest // piece)
    for i in range(n):
        size = rest // n + (i < rest % n)
        out.append((start, size))
        start += size
    return out


SCHEMA = "{key} {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    *,
    key: str = "doc_id",
    capacity: int = 2048,
    piece: int = 512,
    fine: int = 24,
    fine_share: float = 0.03,
    group_windows: int = 192,
    ids: bool = False,
) -> DataFrame:
    """A row per piece: where it stands in its document and in its sequence; ``ids`` adds the ids themselves.

    ``sequence_id`` is unique: the task's number and a count within the task.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sequence = TaskContext.get().partitionId() << 32
        held, size = [], 0

        def emit(group: list) -> pd.DataFrame:
            nonlocal sequence
            rows, rest, left = [], [], (1 - fine_share) * size
            for k, values in group:
                most = piece if left > 0 else fine
                left -= len(values) % capacity
                for start, length in pieces(len(values), capacity, most):
                    row = [k, start, length, zlib.crc32(values[start : start + length].tobytes()), len(values), None, 0]
                    if ids:
                        row.append(values[start : start + length].astype(np.int32))
                    rows.append(row)
                    if length == capacity:
                        row[5] = sequence
                        sequence += 1
                    else:
                        rest.append(row)
            for members in windows([r[2] for r in rest], capacity):
                offset = 0
                for i in members:
                    rest[i][5], rest[i][6] = sequence, offset
                    offset += rest[i][2]
                sequence += 1
            names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * ids
            return pd.DataFrame(rows, columns=names, dtype=object)

        for frame in blocks(frames):
            for k, values in zip(frame[key], encoder(tokenizer).ids(list(frame["text"]))):
                held.append((None if pd.isna(k) else k, np.append(values, np.uint32(end_id)).astype("<u4")))
                size += (len(values) + 1) % capacity
                if size >= group_windows * capacity:
                    yield emit(held)
                    held, size = [], 0
        if held:
            yield emit(held)

    rows = docs.select(F.col(key), F.col("text").cast("string").alias("text"))
    schema = SCHEMA.format(key=f"`{key}`", kind=docs.schema[key].dataType.simpleString()) + (", ids array<int>" if ids else "")
    return rows.mapInPandas(run, schema)
