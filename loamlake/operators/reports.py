"""Usage reports: activity by time, groups with small-cell suppression, cohorts, mixes, charts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamlake.functions.formats import local_time, month, weekday_label

# Fixed value: cells with fewer distinct users are not reported.
MIN_USERS = 10


def activity(df: DataFrame, by: Mapping[str, Column], *, user: str | None = None, messages: str | None = None) -> DataFrame:
    """Conversations per group; with ``user`` also distinct users, with ``messages`` their sum."""
    measures = [F.count("*").alias("conversations")]
    if user:
        measures.append(F.count_distinct(user).alias("unique_users"))
    if messages:
        measures.append(F.coalesce(F.sum(messages), F.lit(0)).alias("messages"))
    return df.groupBy(*[c.alias(name) for name, c in by.items()]).agg(*measures)


def by_hour(df: DataFrame, ts: str, user: str) -> DataFrame:
    """Per hour of day, Bangkok time."""
    return activity(df, {"hour_local": F.hour(local_time(F.col(ts)))}, user=user)


def by_month(df: DataFrame, ts: str, user: str, messages: str | None = None) -> DataFrame:
    """Per calendar month, Bangkok time."""
    return activity(df, {"month": month(local_time(F.col(ts)))}, user=user, messages=messages)


def by_weekday(df: DataFrame, ts: str) -> DataFrame:
    """Per weekday, Bangkok time, Monday = 0."""
    counted = activity(df, {"dow_num": F.weekday(local_time(F.col(ts)))})
    return counted.select("dow_num", weekday_label(F.col("dow_num")).alias("dow_label"), "conversations")


def by_group(df: DataFrame, by: Mapping[str, Column], user: str, min_users: int = MIN_USERS) -> DataFrame:
    """Conversations and distinct users per group, small groups left out."""
    return activity(df, by, user=user).filter(F.col("unique_users") >= min_users)


def by_user_group(
    df: DataFrame,
    user: str,
    period: Mapping[str, Column],
    users: DataFrame,
    groups: Sequence[str],
    min_users: int = MIN_USERS,
) -> DataFrame:
    """Conversations and distinct users per period and group of ``users`` (one row per user).

    Conversations are counted per user and period before anything is joined, so
    a user with a third of all rows is a few rows, and a user counts once
    without a distinct.
    """
    counted = df.groupBy(user, *[c.alias(name) for name, c in period.items()]).agg(F.count("*").alias("_n"))
    grouped = counted.join(users.select(user, *groups), user).groupBy(*period, *groups)
    cells = grouped.agg(F.sum("_n").alias("conversations"), F.count("*").alias("unique_users"))
    return cells.filter(F.col("unique_users") >= min_users)


def email_domain(address: Column) -> Column:
    """Group of a user: what follows the at sign, lower case."""
    return F.nullif(F.lower(F.regexp_extract(address, r"@([^@\s]+)\s*$", 1)), F.lit(""))


def cohorts(df: DataFrame, ts: str, user: str) -> DataFrame:
    """New users per month of their first appearance, Bangkok time."""
    first = df.groupBy(user).agg(F.min(ts).alias("first_seen"))
    return first.groupBy(month(local_time(F.col("first_seen"))).alias("signup_month")).agg(F.count("*").alias("new_users"))


def mix(df: DataFrame, dimensions: Mapping[str, Column], user: str) -> DataFrame:
    """(dimension, value, users): distinct users per value, all dimensions in one pass."""
    pairs = [F.struct(F.lit(name).alias("dimension"), c.cast("string").alias("value")) for name, c in dimensions.items()]
    long = df.select(user, F.explode(F.array(*pairs)).alias("_p")).select(user, "_p.*")
    return long.groupBy("dimension", "value").agg(F.count_distinct(user).alias("users"))


def collection_profile(tables: Mapping[str, DataFrame], sizes: DataFrame) -> DataFrame:
    """Rows and stored megabytes per collection; ``sizes`` (collection, bytes) comes from the file listing."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("doc_count")).select(F.lit(name).alias("collection"), "doc_count")
        out = one if out is None else out.unionByName(one)
    joined = out.join(sizes, "collection", "left")
    return joined.select("collection", "doc_count", F.round(F.coalesce("bytes", F.lit(0)) / 1048576, 3).alias("data_mb"))


def chart(
    df: DataFrame,
    *,
    columns: Sequence[str] = (),
    metrics: Mapping[str, Column] | None = None,
    order: Sequence[Column] = (),
    row_limit: int | None = None,
) -> DataFrame:
    """One chart's query: grouped metrics, or raw columns; then order and row limit.

    Without columns it is the big number; ordered by its metric it is the pie.
    """
    if metrics:
        out = df.groupBy(*columns).agg(*[c.alias(name) for name, c in metrics.items()])
    else:
        out = df.select(*columns)
    if order:
        out = out.orderBy(*order)
    return out.limit(row_limit) if row_limit is not None else out


def having(df: DataFrame, by: Sequence[str], measures: Mapping[str, Column], condition: Column) -> DataFrame:
    """Groups whose measures meet a condition."""
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in measures.items()]).filter(condition)
