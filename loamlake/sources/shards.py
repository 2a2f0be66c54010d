"""Reading back what a corpus run wrote: shard listing, records, manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamlake.runtime import path_exists

SHARD = r"/shard=(\d{5,})/"
# Sidecars: a key and its figures per record, and a bucket per record and band.
KEYS, BANDS = "_keys", "_bands"
KEY_SCHEMA = "_key string, char_count bigint, source string, dataset_id string, dataset_name string, topic string, shard int"
BAND_SCHEMA = "bucket binary, shard int"


def list_shards(spark: SparkSession, root: str) -> DataFrame:
    """(shard, path, bytes) of the written shards; contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(root)
    shard = F.regexp_extract("path", SHARD, 1)
    return listed.filter(shard != "").select(shard.cast("int").alias("shard"), "path", F.col("length").alias("bytes"))


def next_shard(spark: SparkSession, root: str) -> int:
    """Number the next run starts at: highest written one plus one, or 0."""
    if not path_exists(spark, root):
        return 0
    last = list_shards(spark, root).agg(F.max("shard")).first()[0]
    return 0 if last is None else last + 1


def written_records(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, text, char_count) of written shards; empty texts and unreadable shards are skipped."""
    df = spark.read.option("ignoreCorruptFiles", True).parquet(root).select("doc_id", "text", "char_count")
    return df.filter(F.col("text") != "")


def read_sidecar(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Rows of a sidecar, with their ``shard``; none when there is no such sidecar."""
    schema = {KEYS: KEY_SCHEMA, BANDS: BAND_SCHEMA}[name]
    path = f"{root}/{name}"
    return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)


def without_sidecar(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """Records of the shards that have no sidecar, as a run leaves them that broke off, or None; no other shard is opened."""
    have = list_shards(spark, f"{root}/{name}").select("shard").distinct() if path_exists(spark, f"{root}/{name}") else spark.createDataFrame([], "shard int")
    lacking = list_shards(spark, root).select("shard").distinct().join(have, "shard", "left_anti")
    if lacking.isEmpty():
        return None
    return spark.read.option("ignoreCorruptFiles", True).parquet(root).join(F.broadcast(lacking), "shard").filter(F.col("text") != "")


def read_manifest(spark: SparkSession, root: str) -> DataFrame | None:
    """Latest totals row of a run, or None when there is no readable manifest."""
    if not path_exists(spark, f"{root}/_manifest/totals"):
        return None
    df = spark.read.json(f"{root}/_manifest/totals")
    return None if "total_chars" not in df.columns or df.isEmpty() else df
