"""Session, shared scratch folder and lineage helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Spark removes the shuffle files of a query when it ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(app: str = "loamlake", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir`` of the session.

    Only a local master may fall back to a folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="loamlake-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh path for one job's intermediate files, below the shared folder."""
    return f"{shared_dir(spark)}/loamlake/{label}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, uri: str) -> bool:
    """Whether a file or folder is there, on whatever file system the session knows."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def is_folder(spark: SparkSession, uri: str) -> bool:
    """Whether a folder stands at ``uri``."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.exists(path) and files.getFileStatus(path).isDirectory()


def spread(scan: DataFrame) -> DataFrame:
    """A file scan with fewer splits than the session has cores, dealt out to all of them.

    For costly text work on few large row groups. A scan with enough splits is
    returned as it is, so nothing is shuffled at scale. Only planning happens here.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    splits = scan._jdf.queryExecution().toRdd().getNumPartitions()
    return scan.repartition(cores) if splits < cores else scan


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """What the queries run inside shuffled goes with the end of each."""
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


def cut_lineage(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lost executor costs no recomputation.

    Unlike ``checkpoint`` this computes the plan once, and the columnar copy
    can be read column by column and has known sizes. What the plan shuffled goes with its end:
    else it fills the disk until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    with freed_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*cuts: DataFrame) -> None:
    """Remove the scratch files of tables that nothing reads any more; other files stay."""
    for df in cuts:
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            if "/loamlake/" in folder:
                path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
