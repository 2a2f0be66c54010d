"""Versioned tables on plain parquet: audit columns, refresh, append, pinned release, upkeep.

A table is a folder of version directories and a small JSON log with one row
per commit. A commit lists the directories that make up the version, so a
reader picks its files once and never sees half a load. One writer per table.
Where a table format is at hand its own versions replace all of this.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamlake.runtime import path_exists

# Audit columns of ingested rows; uploads carry uploader and unit in place of the source table.
AUDIT = ["_ingested_at", "_source_system", "_source_table", "_run_id"]
UPLOAD_AUDIT = ["_ingested_at", "_source_system", "_uploaded_by", "_org_unit", "_run_id"]
DAY = "_ingest_day"
LOG = "version string, committed_at timestamp_ntz, operation string, row_count bigint, run_id string, parts array<string>"


def with_audit(df: DataFrame, ingested_at: str, **labels: str) -> DataFrame:
    """Add ``_ingested_at``, the given audit labels and the day the table is partitioned by."""
    stamped = df.withColumn("_ingested_at", F.lit(ingested_at).cast("timestamp_ntz"))
    for name, value in labels.items():
        stamped = stamped.withColumn(f"_{name}", F.lit(value))
    return stamped.withColumn(DAY, F.to_date("_ingested_at"))


def without_audit(df: DataFrame) -> DataFrame:
    """The columns of a published view: everything but the audit columns."""
    return df.select(*[c for c in df.columns if c not in {*AUDIT, *UPLOAD_AUDIT, DAY}])


def log(spark: SparkSession, table: str) -> DataFrame:
    """Commits of a table; empty when there is none."""
    if not path_exists(spark, f"{table}/_log"):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).json(f"{table}/_log")


def latest_version(spark: SparkSession, table: str) -> str | None:
    """Id of the newest commit, as text."""
    return log(spark, table).agg(F.max_by("version", F.struct("committed_at", "version"))).first()[0]


def _commit(spark: SparkSession, table: str, version: str, operation: str, rows: int, run_id: str, parts: list[str], at: str) -> None:
    row = (version, datetime.fromisoformat(at), operation, rows, run_id, parts)
    spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").json(f"{table}/_log")


def _now() -> str:
    return datetime.now(timezone.utc).replace(tzinfo=None).isoformat()


def write_table(df: DataFrame, table: str, *, operation: str = "replace", run_id: str = "", at: str | None = None) -> tuple[str, int]:
    """Write one version: ``replace`` swaps the contents, ``append`` adds to them; (version, rows written).

    Rows are counted from the written files' footers. The version becomes visible with
    its log row, after all its files are in place.
    """
    spark = df.sparkSession
    previous = latest_version(spark, table)
    version = f"{int(previous) + 1 if previous else 1:012d}"
    part = f"v={version}"
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if DAY in df.columns:
        writer = writer.partitionBy(DAY)
    writer.parquet(f"{table}/{part}")
    rows = spark.read.schema(df.schema).parquet(f"{table}/{part}").count()
    kept = _parts(spark, table, previous) if operation == "append" and previous else []
    _commit(spark, table, version, operation, rows, run_id, [*kept, part], at or _now())
    return version, rows


def _parts(spark: SparkSession, table: str, version: str) -> list[str]:
    return log(spark, table).filter(F.col("version") == version).select("parts").first()[0]


def read_table(spark: SparkSession, table: str, version: str | None = None) -> DataFrame:
    """The newest version, or the named one."""
    version = version or latest_version(spark, table)
    if version is None:
        raise ValueError(f"no version of {table}")
    parts = [spark.read.parquet(f"{table}/{p}") for p in _parts(spark, table, version)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def publish(spark: SparkSession, curated: str, published: str, at: str | None = None) -> tuple[str, str, int]:
    """Copy the newest curated version, pinned before reading; (source version, published version, rows)."""
    source = latest_version(spark, curated)
    if source is None:
        raise ValueError("source_has_no_snapshot")
    version, rows = write_table(read_table(spark, curated, source), published, run_id=source, at=at)
    return source, version, rows


def compact(spark: SparkSession, table: str, files: int, at: str | None = None) -> str:
    """The same rows in fewer files, as a new version."""
    df = read_table(spark, table)
    version, _ = write_table(df.repartition(files), table, operation="replace", run_id="optimize", at=at)
    return version


def expired(spark: SparkSession, table: str, older_than: str) -> DataFrame:
    """Versions committed before ``older_than``; the newest one never expires."""
    current = latest_version(spark, table)
    return log(spark, table).filter((F.col("committed_at") < F.lit(older_than).cast("timestamp_ntz")) & (F.col("version") != current))


def orphan_files(spark: SparkSession, table: str, live: DataFrame) -> DataFrame:
    """(path, bytes) of data files no live version refers to; contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(table)
    part = F.regexp_extract("path", r"/(v=\d{12})/", 1)
    files = listed.select("path", F.col("length").alias("bytes"), part.alias("part"))
    return files.join(live.select(F.explode("parts").alias("part")).distinct(), "part", "left_anti").select("path", "bytes")


def expire(spark: SparkSession, table: str, older_than: str, *, dry_run: bool = True) -> list[str]:
    """Version directories that only expired versions use; deleted unless ``dry_run``."""
    gone = expired(spark, table, older_than)
    live = log(spark, table).join(gone.select("version"), "version", "left_anti")
    unused = gone.select(F.explode("parts").alias("part")).distinct().join(
        live.select(F.explode("parts").alias("part")).distinct(), "part", "left_anti"
    )
    parts = sorted(r.part for r in unused.collect())  # a few directories, not files
    if not dry_run:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        for part in parts:
            path = hadoop.Path(f"{table}/{part}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return parts
