"""Token-id files: concatenated ids, document boundaries in Elias-Fano form.

A file is a folder of parquet parts that Spark writes and reads on any file
system. A row is a block of about ``block_ids`` ids of consecutive documents:
the ids at the narrowest width that holds them, the documents' keys, and the
boundaries as an Elias-Fano sequence with a select structure. The blocks of a
write task know their place in the task; a small index table holds each task's
total, so no 64-bit table of all boundaries exists anywhere.

Cases: a null text is an empty one (the end id alone); repeated rows each keep
their place, ordered by key, then text; a null key comes first; an empty table gives an empty file;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamlake.llm.blocks import blocks
from loamlake.llm.encoder import encoder

SAMPLE = 64  # a select sample for so many boundaries


class EliasFano:
    """A non-decreasing sequence of ``n`` numbers up to ``top`` in about 2 + log2(top / n) bits each.

    The low bits stand packed; the high bits are a unary bit string. ``samples``
    holds where every SAMPLE-th one stands, so ``select`` looks at few bytes.
    """

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits = n, low_bits
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        self.samples = np.frombuffer(samples, np.uint32)

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        low_bits = max(0, int(np.floor(np.log2(top / n)))) if n else 0
        bits = (values[:, None] >> np.arange(low_bits)) & 1 if low_bits else np.zeros((n, 0), np.int64)
        ones = (values >> low_bits) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        pack = lambda x: np.packbits(x.astype(np.uint8).ravel(), bitorder="little").tobytes()
        return cls(n, low_bits, pack(bits), pack(high), ones[::SAMPLE].astype(np.uint32).tobytes())

    def select(self, i: int) -> int:
        """The ``i``-th number."""
        at, wanted = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        bits = np.unpackbits(self.high[byte : byte + 1], bitorder="little")
        bits[: at % 8] = 0
        while (count := int(bits.sum())) <= wanted:
            wanted -= count
            byte += 1
            bits = np.unpackbits(self.high[byte : byte + 1], bitorder="little")
        place = byte * 8 + int(np.flatnonzero(bits)[wanted])
        return (place - i) << self.low_bits | self._low(i)

    def _low(self, i: int) -> int:
        begin, end = i * self.low_bits, (i + 1) * self.low_bits
        packed = int.from_bytes(self.low[begin // 8 : (end + 7) // 8].tobytes(), "little")
        return packed >> begin % 8 & (1 << self.low_bits) - 1

    def all(self) -> np.ndarray:
        """The whole sequence."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        low = bits.astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return (ones - np.arange(self.n)) << self.low_bits | low


BLOCK = (
    "part int, block int, part_offset bigint, n_docs int, n_ids bigint, width int, keys binary, null_keys binary, ids binary, "
    "low_bits int, low binary, high binary, samples binary"
)


def _block(part: int, number: int, offset: int, keys: list, docs: list[np.ndarray]) -> dict:
    ids = np.concatenate(docs)
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    bounds = EliasFano.encode(np.cumsum([len(d) for d in docs]))
    empty = pd.isna(pd.Series(keys, dtype=object)).to_numpy()
    return {
        "part": part, "block": number, "part_offset": offset, "n_docs": len(docs), "n_ids": len(ids), "width": width,
        "keys": np.array([0 if e else k for k, e in zip(keys, empty)], np.int64).tobytes(), "null_keys": np.packbits(empty).tobytes(),
        "ids": ids.astype("<u2" if width == 2 else "<u4").tobytes(), "low_bits": bounds.low_bits,
        "low": bounds.low.tobytes(), "high": bounds.high.tobytes(), "samples": bounds.samples.tobytes(),
    }


def write_token_file(docs: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", block_ids: int = 1 << 20) -> None:
    """Encode ``text`` of every row, append ``end_id`` and write the ids in ascending order of the whole-number ``key``.

    Texts move once, by a range of the key; they are encoded after that, so the
    sampling of the range reads keys only. A task holds one block of ids.
    """

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number, offset = TaskContext.get().partitionId(), 0, 0
        keys, held, size = [], [], 0
        for frame in blocks(frames):
            for k, ids in zip(frame["key"], encoder(tokenizer).ids(list(frame["text"]))):
                keys.append(k)
                held.append(np.append(ids, np.uint32(end_id)))
                size += len(ids) + 1
                if size >= block_ids:
                    yield pd.DataFrame([_block(part, number, offset, keys, held)])
                    number, offset, keys, held, size = number + 1, offset + size, [], [], 0
        if held:
            yield pd.DataFrame([_block(part, number, offset, keys, held)])

    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange("key").sortWithinPartitions(F.col("key").asc_nulls_first(), "text")
    ordered.mapInPandas(encode, BLOCK).write.option("compression", "zstd").parquet(f"{path}/blocks")
    # One row per write task: the sum over the tasks before it is small work.
    parts = docs.sparkSession.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts.select("part", F.coalesce(before, F.lit(0)).alias("offset")).write.parquet(f"{path}/index")


def read_token_file(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """key, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids of every document."""

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                ends = EliasFano(row.n_docs, row.low_bits, row.low, row.high, row.samples).all()
                starts = np.concatenate([[0], ends[:-1]])
                values = np.frombuffer(row.ids, "<u2" if row.width == 2 else "<u4").astype("<u4")
                empty = np.unpackbits(np.frombuffer(row.null_keys, np.uint8))[: row.n_docs].astype(bool)
                own = [values[s:e] for s, e in zip(starts, ends)]
                out = pd.DataFrame({
                    "key": pd.array(np.frombuffer(row.keys, np.int64), "Int64"), "start": starts + row.part_offset + row.offset,
                    "n_tokens": ends - starts, "ids_crc32": [zlib.crc32(x.tobytes()) for x in own],
                })
                out.loc[empty, "key"] = pd.NA
                yield out.assign(ids=own) if ids else out

    stored = spark.read.parquet(f"{path}/blocks")
    index = spark.read.parquet(f"{path}/index")
    schema = "key bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" if ids else "")
    # Bounded: one row per write task.
    return stored.join(F.broadcast(index), "part").mapInPandas(decode, schema)
