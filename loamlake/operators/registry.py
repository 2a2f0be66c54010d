"""Control-plane operators: registries, run logs, freshness, catalogue, checks.

All of them are joins and aggregations over DataFrames. "Latest" is always a
max over a struct, which combines before the shuffle, never a sort per key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamlake.functions.formats import age_hours
from loamlake.operators.running import row_number


# -- safe columns ---------------------------------------------------------


def is_safe() -> Column:
    """Public at level 0; every other label, known or not, is unsafe."""
    return F.coalesce((F.col("classification") == "public") & (F.col("secret_level") == 0), F.lit(False))


def safe_columns(registry: DataFrame, table: str) -> list[str]:
    """Names of the safe columns of one table, sorted (a table's registry rows are few)."""
    rows = registry.filter((F.col("table_name") == table) & is_safe()).select("column_name").distinct()
    return sorted(r.column_name for r in rows.collect())


def safe_by_table(registry: DataFrame) -> dict[str, list[str]]:
    """Safe columns of all registered tables, in name order; one row per table reaches the driver."""
    listed = registry.filter(is_safe()).groupBy("table_name").agg(F.array_sort(F.collect_set("column_name")).alias("columns"))
    return {r.table_name: list(r.columns) for r in listed.collect()}


def safe_projection(df: DataFrame, registry: DataFrame, table: str) -> DataFrame:
    """Exactly the safe columns; refuses a table that has none. Never a bare star."""
    names = [c for c in safe_columns(registry, table) if c in df.columns]
    if not names:
        raise ValueError(f"no safe column in {table}")
    return df.select(*names)


def load_decisions(tables: DataFrame, registry: DataFrame, hosts_allowed: Column) -> DataFrame:
    """For every registered table: load, or skip with the reason; never a silent gap.

    ``tables``: table_name, host, has_registry, source_active, load_mode, incremental_column.
    """
    counts = registry.groupBy("table_name").agg(
        F.count("*").alias("published"),
        F.count_if(is_safe()).alias("safe"),
    )
    marks = registry.filter(is_safe()).select("table_name", F.col("column_name").alias("incremental_column"), F.lit(True).alias("mark_safe"))
    joined = tables.join(counts, "table_name", "left").join(marks.distinct(), ["table_name", "incremental_column"], "left")
    published, safe = F.coalesce("published", F.lit(0)), F.coalesce("safe", F.lit(0))
    reason = (
        F.when(~hosts_allowed, "host is not permitted")
        .when(~F.col("has_registry"), "source has no column registry")
        .when(~F.col("source_active"), "table is inactive at its source")
        .when(published == 0, "table has no classified column")
        .when(safe == 0, F.concat(F.lit("none of "), published.cast("string"), F.lit(" classified columns is safe")))
        .when(
            (F.col("load_mode") == "incremental") & F.col("mark_safe").isNull(),
            F.concat(F.lit("load mark "), F.col("incremental_column"), F.lit(" is not a safe column")),
        )
    )
    return joined.select(
        "table_name",
        F.when(reason.isNull(), "load").otherwise("skipped").alias("decision"),
        reason.alias("skip_reason"),
        safe.alias("columns_selected"),
        (published - safe).alias("columns_excluded"),
    )


# -- joins and lookups ----------------------------------------------------


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``columns`` of the row with the greatest ``order`` per key."""
    ordered = [c for c in order if c not in keys]
    rest = [c for c in columns if c not in ordered and c not in keys]
    latest = df.groupBy(*keys).agg(F.max(F.struct(*ordered, *rest)).alias("_last"))
    return latest.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in columns if c not in keys])


def ingest_plan(tables: DataFrame, systems: DataFrame, marks: DataFrame) -> DataFrame:
    """Enabled tables of enabled systems with their mark, where there is one."""
    return (
        tables.filter("is_enabled")
        .join(systems.filter("system_enabled"), "source_system_id")
        .join(marks, "source_table_id", "left")
    )


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key; others are kept or added.

    ``new`` must hold one row per key.
    """
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new.select(*old.columns))


def insert_absent(old: DataFrame, seed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` plus the seed rows whose key it lacks."""
    return old.unionByName(seed.join(old.select(*keys).distinct(), list(keys), "left_anti").select(*old.columns))


def fill_nulls(df: DataFrame, lookup: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """NULLs of ``columns`` filled from ``lookup`` (one row per key); filled values stay."""
    renamed = lookup.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    filled = [F.coalesce(c, f"_new_{c}").alias(c) if c in columns else F.col(c) for c in df.columns]
    return df.join(renamed, list(keys), "left").select(*filled)


def members(accounts: DataFrame, reserved: DataFrame) -> DataFrame:
    """(group_name, username) grants of accounts, reserved names skipped."""
    grants = accounts.select("username", F.explode("groups").alias("group_name"))
    return grants.join(reserved.select("username").distinct(), "username", "left_anti").select("group_name", "username")


def member_lines(grants: DataFrame, line_size: int = 1000, base: DataFrame | None = None) -> DataFrame:
    """Groups as comma lists, ``line_size`` members per line: the members of ``base`` (group_name, username, place) in their order, then all others by name.

    A group of any size becomes as many numbered lines as it needs, so no list
    grows with the data.
    """
    every = grants.select("group_name", "username", F.lit(None).cast("bigint").alias("place"))
    if base is not None:
        every = every.unionByName(base.select("group_name", "username", F.col("place").cast("bigint")))
    # A member named on both sides stands where the base has it.
    once = every.groupBy("group_name", "username").agg(F.coalesce(F.min("place"), F.lit((1 << 63) - 1)).alias("place"))
    placed = row_number(once, ["place", "username"], ["group_name"])
    line = F.floor((F.col("position") - 1) / line_size).cast("int").alias("line")
    listed = placed.groupBy("group_name", line).agg(F.sort_array(F.collect_list(F.struct("position", "username"))).alias("names"))
    return listed.select("group_name", "line", F.size("names").alias("size"), F.array_join("names.username", ",").alias("members"))


def next_versions(requests: DataFrame, releases: DataFrame, order: Sequence[str]) -> DataFrame:
    """Version numbers for a batch of requests: the highest existing one plus their place in line."""
    highest = releases.groupBy("table_name").agg(F.max("version").alias("highest"))
    placed = row_number(requests, order, ["table_name"])
    return placed.join(highest, "table_name", "left").select(
        "table_name", *order, (F.coalesce("highest", F.lit(0)) + F.col("position")).cast("bigint").alias("version")
    )


# -- freshness and catalogue ----------------------------------------------


def freshness(tables: DataFrame, systems: DataFrame, runs: DataFrame, as_of: Column) -> DataFrame:
    """One row per registered table: last success, last attempt and the age of the former."""
    last = runs.groupBy("source_table_id").agg(
        F.max(F.when(F.col("status") == "succeeded", F.struct("started_at", "run_id", "rows_written"))).alias("ok"),
        F.max(F.struct("started_at", "run_id", "status", "skip_reason")).alias("any"),
    )
    return (
        tables.join(systems, "source_system_id")
        .join(last, "source_table_id", "left")
        .select(
            "source_table_id",
            "target_table",
            "source_key",
            "load_mode",
            "is_enabled",
            F.col("ok.started_at").alias("last_success_started_at"),
            F.col("ok.rows_written").alias("last_success_rows"),
            F.col("any.status").alias("last_status"),
            F.col("any.started_at").alias("last_attempt_started_at"),
            F.col("any.skip_reason").alias("skip_reason"),
            age_hours(F.col("ok.started_at"), as_of).alias("age_since_last_success_hours"),
        )
    )


def availability() -> Column:
    """retired, published, withheld or pending."""
    return (
        F.when(~F.col("is_enabled"), "retired")
        .when(F.col("last_success_started_at").isNotNull(), "published")
        .when(F.col("last_status") == "skipped", "withheld")
        .otherwise("pending")
    )


def catalogue(fresh: DataFrame, details: DataFrame, classes: DataFrame) -> DataFrame:
    """Freshness plus labels and the number of withheld columns per table.

    ``details``: source_table_id, title, title_en, domain, data_owner. ``classes``: registry rows.
    """
    counted = classes.groupBy("source_table_id").agg(
        F.count("*").alias("column_count"), F.count_if(is_safe()).alias("safe_column_count")
    )
    zero = F.lit(0)
    total, safe = F.coalesce("column_count", zero), F.coalesce("safe_column_count", zero)
    return (
        fresh.join(details, "source_table_id")
        .join(counted, "source_table_id", "left")
        .select(
            "source_table_id",
            F.col("target_table").alias("dataset_key"),
            F.coalesce("title", "target_table").alias("title"),
            F.coalesce("title_en", "title", "target_table").alias("title_en"),
            F.coalesce("domain", F.lit("unsorted")).alias("domain"),
            "data_owner",
            "load_mode",
            "is_enabled",
            availability().alias("availability"),
            "last_success_started_at",
            "last_success_rows",
            "last_status",
            total.alias("column_count"),
            safe.alias("safe_column_count"),
            (total - safe).alias("withheld_column_count"),
        )
    )


def catalogue_stats(catalog: DataFrame, runs: DataFrame, as_of: Column) -> DataFrame:
    """The one-row summary of the catalogue and of the last week's runs."""
    stats = catalog.agg(
        F.count("*").alias("datasets_total"),
        F.count_if(F.col("availability") == "published").alias("datasets_published"),
        F.count_distinct("data_owner").alias("data_owners"),
        F.count_if(F.col("last_success_started_at") > as_of - F.expr("INTERVAL 24 HOURS")).alias("fresh_within_24h"),
        F.coalesce(F.sum("withheld_column_count"), F.lit(0)).alias("columns_withheld"),
    )
    recent = runs.filter(F.col("started_at") > as_of - F.expr("INTERVAL 7 DAYS")).agg(
        F.count_if(F.col("status") == "succeeded").alias("runs_succeeded_7d"), F.count("*").alias("runs_total_7d")
    )
    # Two one-row results side by side.
    return stats.withColumn("_one", F.lit(1)).join(recent.withColumn("_one", F.lit(1)), "_one").drop("_one")


def domain_counts(domains: DataFrame, catalog: DataFrame, catch_all: str = "unsorted") -> DataFrame:
    """Datasets per domain; empty domains stay, the catch-all only when it holds something."""
    counted = catalog.groupBy("domain").agg(
        F.count("*").alias("dataset_count"), F.count_if(F.col("availability") == "published").alias("published_count")
    )
    zero = F.lit(0)
    return (
        domains.join(counted, domains["key"] == counted["domain"], "left")
        .filter(F.col("dataset_count").isNotNull() | (F.col("key") != catch_all))
        .select(
            *domains.columns,
            F.coalesce("dataset_count", zero).alias("dataset_count"),
            F.coalesce("published_count", zero).alias("published_count"),
        )
    )


def merge_releases(catalog: DataFrame, releases: DataFrame, columns: Sequence[str], key: str = "dataset_key") -> DataFrame:
    """Releases replace catalogue rows of the same key and add the others; ``is_new`` marks additions."""
    new = releases.select(key, *[F.col(c).alias(f"_r_{c}") for c in columns], F.lit(True).alias("_released"))
    old = catalog.select(key, *columns, F.lit(True).alias("_listed"))
    pick = [F.when(F.col("_released"), F.col(f"_r_{c}")).otherwise(F.col(c)).alias(c) for c in columns]
    return old.join(new, key, "full_outer").select(key, *pick, F.col("_listed").isNull().alias("is_new"))


def bump_domains(domain_rows: DataFrame, merged: DataFrame) -> DataFrame:
    """Domain counts raised by the added releases only; a replaced entry was counted before."""
    added = merged.filter("is_new").groupBy(F.col("domain").alias("key")).agg(F.count("*").alias("added"))
    bump = F.coalesce("added", F.lit(0))
    return domain_rows.join(added, "key", "left").select(
        "key", (F.col("dataset_count") + bump).alias("dataset_count"), (F.col("published_count") + bump).alias("published_count")
    )


# -- checks ----------------------------------------------------------------


def violations(df: DataFrame, rules: Mapping[str, Column], keys: Sequence[str]) -> DataFrame:
    """(keys, rule) for every rule a row breaks; a NULL verdict passes, as in a CHECK constraint."""
    broken = [F.when(~ok, F.lit(name)) for name, ok in rules.items()]
    return df.select(*keys, F.explode(F.array(*broken)).alias("rule")).filter("rule IS NOT NULL")


def duplicates(df: DataFrame, keys: Sequence[Column], condition: Column | None = None) -> DataFrame:
    """Keys found more than once, among the rows that meet ``condition``."""
    rows = df if condition is None else df.filter(condition)
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def reconcile(actual: DataFrame, expected: DataFrame, key: str, value: str) -> DataFrame:
    """Actual against expected totals per key, with the difference; a missing side counts as 0."""
    zero = F.lit(0)
    joined = actual.select(key, F.col(value).alias("actual")).join(
        expected.select(key, F.col(value).alias("expected")), key, "full_outer"
    )
    return joined.select(
        key,
        F.coalesce("actual", zero).alias("actual"),
        F.coalesce("expected", zero).alias("expected"),
        (F.coalesce("actual", zero) - F.coalesce("expected", zero)).alias("difference"),
    )


def capped(df: DataFrame, max_rows: int) -> DataFrame:
    """The result, or an error as soon as it is read when it has more than ``max_rows`` rows; never a truncated answer.

    At most one row more than allowed is gathered; it is the one that raises.
    """
    nth = F.row_number().over(Window.orderBy(F.lit(0)))
    refused = F.raise_error(F.lit(f"result exceeds {max_rows} rows"))
    checked = df.limit(max_rows + 1).withColumn("_nth", nth)
    return checked.filter(F.when(F.col("_nth") <= max_rows, True).otherwise(refused.cast("boolean"))).drop("_nth")

