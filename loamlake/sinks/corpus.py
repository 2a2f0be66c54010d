"""Corpus shards, manifest and merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loamlake.operators.corpus import dataset_totals
from loamlake.operators.running import assign_shards
from loamlake.sources.shards import KEYS, list_shards, next_shard, read_sidecar

SHARD_CHARS = 100_000_000
# One task writes a merged file, and one task several small shards: so much of them at most, more only of a shard that is larger.
MERGED_FILE_BYTES = 1 << 26
TASK_CHARS = 1 << 27


def write_shards(df: DataFrame, root: str, order: list[str], shard_chars: int = SHARD_CHARS) -> dict:
    """zstd parquet, one directory and one file per shard, numbered after what is there; returns rows and characters written.

    Records without a ``shard`` column are placed by their running characters.
    The figures are observed while writing: nothing is read again.
    """
    first = next_shard(df.sparkSession, root)
    sharded = df if "shard" in df.columns else assign_shards(df, "char_count", order, shard_chars)
    count = sharded.agg(F.coalesce(F.max("shard") + 1, F.lit(1))).first()[0]
    seen = Observation()
    figures = [F.count("*").alias("rows"), F.coalesce(F.sum("char_count"), F.lit(0)).alias("chars")]
    (
        numbered(sharded, first).repartition(write_tasks(df.sparkSession, count, shard_chars), "shard")
        .sortWithinPartitions("shard", *order)
        .observe(seen, *figures)
        .write.mode("append")
        .option("compression", "zstd")
        .option("parquet.compression.codec.zstd.level", "3")
        .partitionBy("shard")
        .parquet(root)
    )
    return {"first": first, "shards": count, "rows": 0, "chars": 0, **seen.get}


def write_tasks(spark: SparkSession, shards: int, shard_chars: int) -> int:
    """Tasks that write ``shards`` shards: no more than their size or the session's cores ask for, as each task reports to the driver."""
    return min(shards, max(2 * spark.sparkContext.defaultParallelism, -(-shards * shard_chars // TASK_CHARS)))


def numbered(df: DataFrame, first: int) -> DataFrame:
    """``shard`` counted from ``first``, with five digits at least."""
    return df.withColumn("shard", F.format_string("%05d", F.col("shard") + first))


def write_sidecar(df: DataFrame, root: str, name: str, first: int, shards: int) -> None:
    """One file per shard of ``df``, which has a ``shard`` counted from ``first``, beside the shards.

    It is written after the shards, so a file that is there covers its shard.
    """
    tasks = min(shards, max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-shards // 32)))
    numbered(df, first).repartition(tasks, "shard").write.mode("append").partitionBy("shard").parquet(f"{root}/{name}")


def manifest_totals(df: DataFrame, target: int | None = None) -> DataFrame:
    """One row: rows, characters, and whether the budget was reached."""
    chars = F.coalesce(F.sum("char_count"), F.lit(0))
    reached = chars >= F.lit(target) if target is not None else F.lit(False)
    return df.agg(
        F.count("*").alias("total_rows"),
        chars.alias("total_chars"),
        F.lit(target).cast("bigint").alias("target"),
        reached.alias("target_reached"),
    )


def write_manifest(spark: SparkSession, root: str, totals: DataFrame) -> None:
    """JSON next to the shards: ``totals``, per dataset, per shard.

    The lists come from the key sidecars, so no written text is read. They
    grow with the data and are written as JSON lines, not as one document.
    """
    totals.coalesce(1).write.mode("overwrite").json(f"{root}/_manifest/totals")
    index = read_sidecar(spark, root, KEYS)
    dataset_totals(index).write.mode("overwrite").json(f"{root}/_manifest/datasets")
    counts = index.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("char_count").alias("chars"))
    list_shards(spark, root).join(counts, "shard", "left").write.mode("overwrite").json(f"{root}/_manifest/shards")


def merge_shards(spark: SparkSession, root: str, out: str, order: list[str], files: int | None = None) -> int:
    """All shards in order as few large files; returns the number of files.

    The default aims at 64 MiB per file, which one task sorts and writes; ``files=1`` asks for a single one.
    """
    size = list_shards(spark, root).agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    files = files or max(1, -(-size // MERGED_FILE_BYTES))
    shards = spark.read.parquet(root)
    ordered = shards.repartitionByRange(files, "shard", *order) if files > 1 else shards.coalesce(1)
    ordered.sortWithinPartitions("shard", *order).drop("shard").write.mode("overwrite").option("compression", "zstd").parquet(out)
    return files
