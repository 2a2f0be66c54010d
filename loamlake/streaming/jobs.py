"""Structured Streaming jobs: file watch, incremental load, deduplication, change-only publishing."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loamlake.functions.text import dedup_key
from loamlake.functions.types import all_strings, typed
from loamlake.sinks.tables import log, with_audit, write_table


def watch_extracts(
    spark: SparkSession,
    folder: str,
    declared: Mapping[str, Mapping[str, str]],
    root: str,
    checkpoint: str,
    at: str | None = None,
    source_key: str = "extracts",
    interval: str | None = None,
) -> list[StreamingQuery]:
    """Load every declared extract ``<table>.csv`` (or ``<table>-*.csv``) that appears in ``folder``.

    One query per table: the table's own columns and types are declared, an
    undeclared file is never read. Files of one table are taken one after the other, the oldest first, and
    each replaces the contents. Without an
    ``interval`` what is there is processed and the queries end. ``at`` is the
    load time; without it each batch carries the time it is loaded.
    """
    started = []
    for table, types in declared.items():
        files = (
            spark.readStream.schema(all_strings(types))
            .option("header", True)
            .option("multiLine", True)
            .option("escape", '"')
            .option("maxFilesPerTrigger", 1)
            .csv(f"{folder}/{table}{{.csv,-*.csv}}")
        )

        def load(batch: DataFrame, epoch: int, table: str = table, types: Mapping[str, str] = types) -> None:
            if batch.isEmpty():
                return
            loaded = at or datetime.now(timezone.utc).replace(tzinfo=None).isoformat()
            rows = with_audit(typed(batch, types), loaded, source_system=source_key, source_table=table, run_id=f"{table}-{epoch}")
            write_table(rows, f"{root}/{table}", run_id=f"{table}-{epoch}", at=loaded)

        writer = files.writeStream.foreachBatch(load).option("checkpointLocation", f"{checkpoint}/{table}")
        trigger = {"processingTime": interval} if interval else {"availableNow": True}
        started.append(writer.trigger(**trigger).start())
    return started


def append_new_files(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Incremental load by source offsets: each input file is loaded once, also across restarts."""
    return (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def dedup_stream(stream: DataFrame, text: str = "text", *, ts: str | None = None, horizon: str = "1 day") -> DataFrame:
    """First copy of every text on a stream.

    Without ``ts`` every key is remembered forever. With ``ts`` a key is
    forgotten ``horizon`` after it was seen, which bounds the state; copies
    further apart then pass again.
    """
    keyed = stream.withColumn("_key", dedup_key(F.col(text)))
    if ts is None:
        return keyed.dropDuplicates(["_key"]).drop("_key")
    return keyed.withWatermark(ts, horizon).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def fingerprint(df: DataFrame) -> Column:
    """Order-free content fingerprint as an aggregate: row count and two sums of row hashes."""
    hashed = [F.col(f"`{c}`") for c in df.columns]
    one = F.xxhash64(*hashed).cast("decimal(20,0)")
    two = F.xxhash64(F.lit(1), *hashed).cast("decimal(20,0)")
    return F.concat_ws(":", F.count("*").cast("string"), F.sum(one).cast("string"), F.sum(two).cast("string"))


def publish_if_changed(df: DataFrame, table: str, at: str | None = None) -> bool:
    """Write a new version only when the content differs from the newest one.

    A version's fingerprint is kept with its commit, so the old contents are not read again.
    """
    spark = df.sparkSession
    new = "content " + df.agg(fingerprint(df).alias("f")).first().f
    newest = log(spark, table).agg(F.max_by("run_id", F.struct("committed_at", "version"))).first()[0]
    if newest == new:
        return False
    write_table(df, table, operation="replace", run_id=new, at=at)
    return True


def publish_changes(changes: DataFrame, derive, table: str, checkpoint: str) -> StreamingQuery:
    """On every batch of changes derive the output afresh and publish it if it differs."""

    def act(batch: DataFrame, epoch: int) -> None:
        publish_if_changed(derive(batch), table)

    return changes.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
