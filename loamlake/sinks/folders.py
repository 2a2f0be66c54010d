"""What a load needs of the file system: a marker that only one can put, a folder that is swapped whole, rows that replace their own run's."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loamlake.runtime import path_exists

ASIDE = ".before"


def _fs(spark: SparkSession, uri: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def put_if_absent(spark: SparkSession, uri: str, body: str) -> bool:
    """Create a small file unless it is there; of several callers one succeeds, as the file system's create promises."""
    fs, path = _fs(spark, uri)
    local = fs.getUri().getScheme() == "file"
    if local:  # there the file system looks first and creates then; the machine's own call does both at once
        fs.mkdirs(path.getParent())
        if not spark.sparkContext._jvm.java.io.File(path.toUri().getPath()).createNewFile():
            return False
    try:
        out = fs.create(path, local)
    except Py4JJavaError as error:
        if "AlreadyExists" in str(error.java_exception):
            return False
        raise
    out.write(bytearray(body, "utf-8"))
    out.close()
    return True


def read_small(spark: SparkSession, uri: str) -> str | None:
    """Contents of a marker, None without one."""
    fs, path = _fs(spark, uri)
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def rename(spark: SparkSession, old: str, new: str) -> bool:
    """Move a file or folder to a name that is free; of several callers one succeeds."""
    fs, path = _fs(spark, old)
    target = _fs(spark, new)[1]
    try:
        return not fs.exists(target) and fs.rename(path, target)
    except Py4JJavaError:
        return False


def remove(spark: SparkSession, uri: str) -> None:
    fs, path = _fs(spark, uri)
    fs.delete(path, True)


def swap_in(spark: SparkSession, staged: str, target: str) -> None:
    """Make the finished folder ``staged`` the contents of ``target``; what was there is put back if that fails."""
    settle(spark, target)
    had = path_exists(spark, target)
    if had and not rename(spark, target, target + ASIDE):
        raise OSError(f"cannot move {target} aside")
    if not rename(spark, staged, target):
        if had:
            rename(spark, target + ASIDE, target)
        raise OSError(f"cannot move {staged} to {target}")
    if had:
        remove(spark, target + ASIDE)


def settle(spark: SparkSession, target: str) -> None:
    """After a swap that broke off: without the new folder the old one comes back, with it the old one goes."""
    if path_exists(spark, target + ASIDE):
        if path_exists(spark, target):
            remove(spark, target + ASIDE)
        else:
            rename(spark, target + ASIDE, target)


def staged_beside(target: str) -> str:
    """A fresh folder name beside ``target``, so that a move is a rename."""
    head, _, name = target.rstrip("/").rpartition("/")
    return f"{head}/.{name}-{uuid.uuid4().hex}"


def refresh(df: DataFrame, target: str, partitions: tuple[str, ...] = ()) -> int:
    """Replace the contents of ``target``, which readers find old or new; rows written, counted while writing."""
    staged, seen = staged_beside(target), Observation()
    writer = df.observe(seen, F.count("*").alias("rows")).write.option("compression", "zstd")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(staged)
    rows = seen.get.get("rows", 0)
    if not rows and partitions:  # else no file would hold the columns
        df.limit(0).write.mode("overwrite").parquet(staged)
    swap_in(df.sparkSession, staged, target)
    return rows


def append_run(df: DataFrame, target: str, run_id: str, partitions: tuple[str, ...] = ()) -> int:
    """Add the rows of one run; the same run again replaces its own rows. Rows written, counted while writing."""
    seen = Observation()
    stamped = df.withColumn("_run_id", F.lit(run_id)).observe(seen, F.count("*").alias("rows"))
    stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("_run_id", *partitions).parquet(target)
    return seen.get.get("rows", 0)


def run_rows(spark: SparkSession, target: str, run_id: str) -> DataFrame | None:
    """The rows of one run of :func:`append_run`, or None when it committed none."""
    if not path_exists(spark, f"{target}/_run_id={run_id}"):
        return None
    return spark.read.parquet(target).filter(F.col("_run_id") == run_id)
