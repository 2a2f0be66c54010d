"""Staged CSV, JDBC tables and catalog metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamlake.functions.types import all_strings

FETCH_SIZE = 5000


def read_staged(spark: SparkSession, folder: str, columns: Sequence[str]) -> DataFrame:
    """A staged CSV directory as a table of texts; the header line is skipped."""
    return spark.read.schema(all_strings(columns)).option("header", True).option("multiLine", True).option("escape", '"').csv(folder)


def jdbc_query(
    spark: SparkSession,
    url: str,
    table: str,
    safe: Sequence[str],
    *,
    properties: dict[str, str] | None = None,
    mark_column: str | None = None,
    mark: str | None = None,
    mark_type: str = "numeric",
    split: tuple[str, int, int, int] | None = None,
) -> DataFrame:
    """Safe columns of a source table, read-only, newer than ``mark``.

    Projection and filter are pushed to the source. ``split`` is (column,
    lower, upper, partitions) for a parallel read.
    """
    if not safe:
        raise ValueError(f"no safe column in {table}")
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("fetchsize", FETCH_SIZE)
    for name, value in (properties or {}).items():
        reader = reader.option(name, value)
    if split:
        column, lower, upper, partitions = split
        reader = (
            reader.option("partitionColumn", column)
            .option("lowerBound", lower)
            .option("upperBound", upper)
            .option("numPartitions", partitions)
        )
    df = reader.load().select(*safe)
    return newer_than(df, mark_column, mark, mark_type) if mark_column else df


def newer_than(df: DataFrame, mark_column: str, mark: str | None, mark_type: str = "numeric") -> DataFrame:
    """Rows strictly above the stored mark (text); all rows without one.

    The mark is cast to the column's own type, so the filter reaches the scan.
    """
    if mark is None:
        return df
    target = df.schema[mark_column].dataType
    literal = F.lit(mark) if mark_type == "text" else F.lit(mark).cast(target)
    return df.filter(F.col(mark_column) > literal)


def next_mark(df: DataFrame, mark_column: str) -> DataFrame:
    """One row: the highest value as text, NULL when no row was read."""
    return df.agg(F.max(mark_column).cast("string").alias("mark"))


def catalog_columns(spark: SparkSession, database: str) -> DataFrame:
    """(table_name, column_name, data_type, position) of the base tables of a database."""
    rows = []
    for table in spark.catalog.listTables(database):
        if table.tableType in ("VIEW", "TEMPORARY"):
            continue
        for position, field in enumerate(spark.table(f"{database}.`{table.name}`").schema, start=1):
            rows.append((table.name, field.name, field.dataType.simpleString(), position))
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, position int")


def release_preview(spark: SparkSession, database: str, table: str) -> DataFrame:
    """Columns, types and row count of a table about to be released; no rows of it."""
    columns = catalog_columns(spark, database).filter(F.col("table_name") == table)
    counted = spark.table(f"{database}.`{table}`").agg(F.count("*").alias("row_count"))
    return columns.select("position", "column_name", "data_type", counted.scalar().alias("row_count")).orderBy("position")
