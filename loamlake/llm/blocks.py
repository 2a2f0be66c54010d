"""Numpy helpers for tasks that work through many texts at once.

All of them see a bounded block of texts, whatever the size of a partition.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from types import ModuleType

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle

U = np.uint64


def shared(name: tuple, make: Callable):
    """``make()``, once per process and name: functions travel with each task, so their module can't keep anything."""
    kept = sys.modules.setdefault("_loamlake_shared", ModuleType("_loamlake_shared")).__dict__
    if name not in kept:
        kept[name] = make()
    return kept[name]


def send(spark, thing) -> Callable:
    """Broadcast ``thing``, which must be of bounded size; the returned function gives it back inside a task."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(thing))
    return lambda: cloudpickle.loads(sent.value)


def fetched(df) -> pd.DataFrame:
    """A table of bounded size on the driver, by Arrow: ``toPandas`` may make an object of every row and every number first."""
    return df.toArrow().to_pandas()


def small_batches(spark, rows: int = 1000) -> None:
    """Let tasks take texts from the engine in batches of ``rows``: a batch is held several times over while it is converted."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, str(rows))


def give_back() -> None:
    """Memory a task has freed goes back to the system: allocators keep it, and a worker that is used again holds the most it ever had."""
    pa.default_memory_pool().release_unused()
    trim = shared(("trim",), lambda: getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None)
    if trim is not None:  # the C library of most Linux systems
        trim(0)


def blocks(frames: Iterator[pd.DataFrame], limit: int = 1 << 20, text: str = "text") -> Iterator[pd.DataFrame]:
    """The rows of ``frames`` in pieces of about ``limit`` characters; one text is never cut. Null texts become empty.

    What is freed goes back to the system with every frame and at the end.
    """
    for frame in frames:
        give_back()
        if not len(frame):
            continue
        frame = frame.assign(**{text: frame[text].fillna("")})
        ends = frame[text].str.len().to_numpy().cumsum()
        begin = 0
        while begin < len(frame):
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield frame.iloc[begin:end]
            begin = end
    give_back()


def joined(texts, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends): the UTF-8 of all texts, one newline after each; ``lower`` changes A-Z only."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    ends = np.cumsum(sizes + 1) - 1
    data = b"\n".join(raw) + b"\n"
    return np.frombuffer(data.lower() if lower else data, np.uint8), ends - sizes, ends


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true."""
    step = np.diff(inside.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def byte_codes() -> np.ndarray:
    return shared(("codes",), lambda: np.random.default_rng(20240517).integers(1, 2**63, size=256, dtype=U) * U(2) + U(1))


BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``size`` powers of the base and of its inverse; longer tables than a few blocks need aren't kept."""

    def make():
        out = []
        for base in (BASE, INVERSE):
            steps = np.full(size, base, U)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        return out[0], out[1]

    return shared(("powers", size), make) if size <= 1 << 23 else make()


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums of coded bytes times powers, so that any range's hash is one difference away; one entry more than ``data``."""
    up, _ = powers(1 << max(16, int(len(data)).bit_length()))
    out = np.zeros(len(data) + 1, U)
    np.cumsum(byte_codes()[data] * up[: len(data)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each range's content, wherever it stands."""
    _, down = powers(1 << max(16, int(len(sums) - 1).bit_length()))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))


def ramp(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count, concatenated."""
    total = int(counts.sum())
    first = np.repeat(np.cumsum(counts) - counts, counts)
    return np.arange(total) - first


WORD_BYTES = np.ones(256, bool)
WORD_BYTES[[0x20, *range(0x09, 0x0E)]] = False


def word_hashes(texts, is_word: np.ndarray = WORD_BYTES, lower: bool = True):
    """(hash of every word, words per text, starts, ends, bytes); words are runs of ``is_word`` bytes."""
    data, first, last = joined(texts, lower)
    starts, ends = spans(is_word[data])
    counts = np.searchsorted(starts, last) - np.searchsorted(starts, first)
    return range_hash(prefix_hash(data), starts, ends), counts, starts, ends, data
