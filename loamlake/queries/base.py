"""Query registry: every entry is an operator applied to the given tables, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loamlake.runtime import spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

TEXTS = {"documents", "pages", "conversations"}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """``t.orders`` reads the table on demand; ``t.sql`` runs SQL that names tables in braces."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread(df) if name in TEXTS else df

    def sql(self, text: str) -> DataFrame:
        used = {name: getattr(self, name) for name in TABLES if f"{{{name}}}" in text}
        return self.spark.sql(text, **used)


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``; ``sql`` is the DuckDB text with the same result."""

    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLE[name] = plain(sql)
        return fn

    return register


def plain(sql: str) -> str:
    """Braces around table names are for Spark only."""
    for name in TABLES:
        sql = sql.replace(f"{{{name}}}", name)
    return sql.strip()
