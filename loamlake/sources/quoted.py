"""CSV with quoted newlines, read by as many tasks as the file has ranges.

Whether a line begins inside a quoted cell depends on all lines before it. A line is
a function of that state: it leaves it, turns it, or sets it. The lines
of a byte range compose to one such function, so a first pass over the
lines gives one row per range, and a scan over those rows says how every range begins. A second pass then cuts
the ranges into records; what a range holds of a record that began before it, and of one that goes
on after it, meets by file and first range. Records are parsed by ``from_csv``.

A quote opens a cell only at the cell's start, and doubled quotes stand for one. Records end with a newline or
a carriage return and a newline; inside quotes both stay as they are. Blank lines are left out. A file's header is the first record of its first range.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamlake.runtime import cut_lineage

PARSE = {"escape": '"', "mode": "PERMISSIVE"}


def still_quoted(line: str, inside: bool) -> bool:
    """Whether a quoted cell is open at the end of ``line``, given whether one is at its start."""
    at = 0
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('""', at):
                at += 2
                continue
            inside = False
        elif line.startswith('"', at):
            inside, at = True, at + 1
            continue
        at = line.find(",", at) + 1
        if not at:
            return False


def _lines(spark: SparkSession, path: str) -> DataFrame:
    meta = F.col("_metadata")
    return spark.read.option("lineSep", "\n").text(path).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), "value")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, from_outside, from_inside): the state after each range for either state before it."""
    at, states, out = None, (False, True), []
    for batch in batches:
        quoted = pc.match_substring(batch.column("value"), '"')
        files, blocks = batch.column("file"), batch.column("block")
        begin = 0
        while begin < batch.num_rows:
            here = (files[begin].as_py(), blocks[begin].as_py())
            if here != at:
                out += [(*at, *states)] if at else []
                at, states = here, (False, True)
            same = pc.and_(pc.equal(files, here[0]), pc.equal(blocks, here[1]))
            end = begin + pc.sum(same.slice(begin)).as_py()  # a range's lines stand together
            for i in pc.indices_nonzero(quoted.slice(begin, end - begin)).to_pylist():
                line = batch.column("value")[begin + i].as_py()
                states = tuple(still_quoted(line, s) for s in states)
            begin = end
    out += [(*at, *states)] if at else []
    columns = list(zip(*out)) or [(), (), (), ()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.bool_(), pa.bool_()))], ["file", "block", "from_outside", "from_inside"])


def _beginnings(ranges: DataFrame) -> DataFrame:
    """(file, block, inside): the state at the start of each range.

    A range sets the state, whatever it was, or keeps or turns it: the last range that set
    it and the turns since then give the state. One row per range takes part.
    """
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    turns = (F.col("from_outside") & ~F.col("from_inside")).cast("int")
    counted = ranges.withColumn("_turns", F.sum(turns).over(Window.partitionBy("file").orderBy("block")))
    set_to = F.when(F.col("from_outside") == F.col("from_inside"), F.col("from_outside").cast("int") + F.col("_turns"))
    known = F.coalesce(F.last(set_to, True).over(before), F.lit(0)) + F.coalesce(F.last("_turns").over(before), F.lit(0))
    return counted.select("file", "block", (known % 2 == 1).alias("inside"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, part, head, record): part 0 is a whole record, 1 the end of one begun before, 2 the start of one that goes on, 3 all of a range inside one."""
    at, inside, held, joined, head = None, False, [], False, False
    out: list[tuple] = []

    def give(part: int, record: str) -> None:
        nonlocal head
        out.append((*at, part, head, record))
        head = False

    def flush() -> pa.RecordBatch:
        types = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["file", "block", "part", "head", "record"])
        out.clear()
        return batch

    for batch in batches:
        for file, block, state, line in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "inside", "value"))):
            if (file, block) != at:
                if held:
                    give(3 if joined else 2, "\n".join(held))
                at, inside, held, joined, head = (file, block), state, [], state, block == 0
            if not inside and '"' not in line:
                if line and line != "\r":
                    give(0, line.removesuffix("\r"))
                continue
            inside = still_quoted(line, inside)
            held.append(line)
            if not inside:
                give(1 if joined else 0, "\n".join(held).removesuffix("\r"))
                held, joined = [], False
        if out:
            yield flush()
    if held:
        give(3 if joined else 2, "\n".join(held))
        yield flush()


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, head, record): every record of the files; ``head`` marks the first one of each."""
    lines = _lines(spark, path)
    ranges = cut_lineage(lines.mapInArrow(_ranges, "file string, block bigint, from_outside boolean, from_inside boolean"), "ranges")
    met = lines.join(F.broadcast(_beginnings(ranges)), ["file", "block"])  # one row per range
    pieces = cut_lineage(met.mapInArrow(_cut, "file string, block bigint, part int, head boolean, record string"), "records")
    # A record's pieces: the range where it starts, ranges inside it, the range where it ends; two rows per range at most.
    upto = Window.partitionBy("file").orderBy("block", F.col("part") == 2).rowsBetween(Window.unboundedPreceding, 0)
    begun = F.last(F.when(F.col("part") == 2, F.col("block")), True).over(upto)
    split = pieces.filter("part > 0").withColumn("_at", begun).groupBy("file", "_at")
    glued = split.agg(F.max("head").alias("head"), F.array_sort(F.collect_list(F.struct("block", "record"))).alias("_parts"))
    return pieces.filter("part = 0").select("file", "head", "record").unionByName(glued.select("file", "head", F.array_join("_parts.record", "\n").alias("record")))


def read_quoted_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV files with a header each; every value text. Records are parsed once for each different header."""
    made = records(spark, path)
    headers = made.filter("head").select("file", F.regexp_replace("record", "^\ufeff", "").alias("header"))
    out = None
    for (header,) in headers.select("header").distinct().orderBy("header").collect():  # the spellings of a header are few
        names: list[str] = []
        for i, name in enumerate(next(csv.reader([header]))):
            names.append(f"_c{i}" if not name else f"{name}{i}" if name in names else name)
        own = F.broadcast(headers.filter(F.col("header") == header).select("file"))  # one row per file
        cells = F.from_csv("record", ", ".join(f"c{i} string" for i in range(len(names))), PARSE)
        parsed = made.filter("NOT head").join(own, "file", "left_semi").select(cells.alias("r")).select("r.*").toDF(*names)
        out = parsed if out is None else out.unionByName(parsed, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no header in {path}")
    return out
