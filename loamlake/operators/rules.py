"""Row rules of the control tables, for :func:`loamlake.operators.registry.violations`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamlake.functions import names as N
from loamlake.functions.text import strip
from loamlake.operators.profile import ACCESS_LEVELS, CADENCES, MAX_TAGS, RELEASE_DOMAINS
from loamlake.operators.registry import duplicates


# States of releases and uploads.
RELEASE_STATES = ["requested", "approved", "published", "failed", "rejected"]
OPEN_RELEASE_STATES = ["requested", "approved"]
UPLOAD_STATES = ["pending_review", "loading", "registered", "rejected"]


def _code(column: str) -> Column:
    return F.col(column).isNull() | F.col(column).rlike("^[a-z_]{1,64}$")


def _filled(column: str) -> Column:
    return F.length(strip(F.coalesce(F.col(column), F.lit("")))) > 0


def source_systems() -> dict[str, Column]:
    """A source names its owner, its legal basis and its retention, and a usable port."""
    return {
        "port_valid": F.col("port").between(1, 65535),
        "governance_stated": _filled("data_owner") & _filled("lawful_basis") & _filled("retention_note"),
    }


def source_tables() -> dict[str, Column]:
    """Incremental loads name their column, full refreshes name none; retention is sane."""
    mode, column = F.col("load_mode"), F.col("incremental_column")
    return {
        "load_mode_known": mode.isin("full_refresh", "incremental"),
        "incremental_needs_column": ((mode == "incremental") & column.isNotNull()) | ((mode == "full_refresh") & column.isNull()),
        "retention_sane": F.col("expire_snapshots_days").between(1, 3650) & F.col("orphan_retention_days").between(1, 3650),
    }


def runs() -> dict[str, Column]:
    """A run that ended says when, a skipped one why, a failed one what happened."""
    status = F.col("status")
    return {
        "status_known": status.isin("running", "succeeded", "failed", "skipped"),
        "skip_has_reason": (status != "skipped") | F.col("skip_reason").isNotNull(),
        "failure_has_message": (status != "failed") | F.col("error_message").isNotNull(),
        "finished_has_end": (status == "running") | F.col("ended_at").isNotNull(),
    }


def releases() -> dict[str, Column]:
    """Shapes, closed lists, and what each state must carry."""
    status = F.col("status")
    bounded = lambda c, n: F.col(c).isNull() | (F.length(c) <= n)
    return {
        "status_known": status.isin(RELEASE_STATES),
        "title_en_bounded": bounded("title_en", 200),
        "description_bounded": bounded("description", 2000),
        "description_en_bounded": bounded("description_en", 2000),
        "changelog_bounded": bounded("changelog", 2000),
        "rejection_bounded": bounded("rejection_reason", 1000),
        "row_count_not_negative": F.col("row_count").isNull() | (F.col("row_count") >= 0),
        "table_name_shape": F.col("table_name").rlike(N.TABLE_NAME),
        "org_unit_shape": F.col("owner_org_unit").rlike(N.ORG_UNIT),
        "version_positive": F.col("version") > 0,
        "title_length": F.length(F.trim("title")).between(1, 200),
        "domain_known": F.col("domain").isNull() | F.col("domain").isin(RELEASE_DOMAINS),
        "access_level_known": F.col("access_level").isin(ACCESS_LEVELS),
        "cadence_known": F.col("refresh_cadence").isin(CADENCES),
        "tags_bounded": F.size("tags") <= MAX_TAGS,
        "decided": (status == "requested") | (F.col("decided_by").isNotNull() & F.col("decided_at").isNotNull()),
        "rejection_has_reason": (status != "rejected") | _filled("rejection_reason"),
        "published_is_pinned": (status != "published")
        | (F.col("source_version").isNotNull() & F.col("published_version").isNotNull() & F.col("published_at").isNotNull()),
        "failure_code_shape": _code("failure_code"),
    }


def uploads() -> dict[str, Column]:
    """An upload has bytes, a known state, and a short code for why its last load failed."""
    return {
        "size_positive": F.col("size_bytes") > 0,
        "status_known": F.col("status").isin(UPLOAD_STATES),
        "load_error_shape": _code("load_error"),
    }


def open_releases(df: DataFrame) -> DataFrame:
    """Tables with more than one open release request."""
    return duplicates(df, [F.col("table_name")], F.col("status").isin(OPEN_RELEASE_STATES))


def doubled_versions(df: DataFrame) -> DataFrame:
    """(table, version) that more than one release has."""
    return duplicates(df, [F.col("table_name"), F.col("version")])


def doubled_addresses(df: DataFrame) -> DataFrame:
    """Addresses that several accounts have, in whatever case; accounts without one are no copies."""
    return duplicates(df, [F.lower("email").alias("email")], F.col("email").isNotNull())
