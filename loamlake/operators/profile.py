"""Column profile of an upload: names, suggested types and personal-data flags."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamlake.functions import names as N
from loamlake.functions.text import strip
from loamlake.functions.types import UPLOAD_TYPES, typed

# The value shapes a type is suggested from, tried in this order.
SHAPES = [
    ("WHOLE", r"^-?[0-9]+$"),
    ("DOUBLE", r"^-?[0-9]+(\.[0-9]+)?$"),
    ("BOOLEAN", r"(?i)^(true|false|t|f|1|0)$"),
    ("DATE", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
    ("TIMESTAMP", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2}"),
]


def column_profile(df: DataFrame) -> DataFrame:
    """(position, original_name, name, type, classification) of an all-text table.

    A type is suggested when every filled value has its shape. All columns are
    judged in one aggregation over the whole table, not over a sample.
    """
    stats = []
    for c in df.columns:
        value = F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`"))
        digits = F.regexp_replace(value, "^-?0*", "")
        # 32-bit range test on text, safe for numbers of any length.
        too_wide = (F.length(digits) > 10) | ((F.length(digits) == 10) & (digits > F.when(F.startswith(value, F.lit("-")), "2147483648").otherwise("2147483647")))
        measures = [F.count(value).alias("filled"), F.max(too_wide).alias("wide")]
        measures += [F.min(value.rlike(shape)).alias(kind) for kind, shape in SHAPES]
        stats += [m.alias(f"{c}\x1f{i}") for i, m in enumerate(measures)]
    row = df.agg(*stats)
    fields = ["filled", "wide", *[kind for kind, _ in SHAPES]]
    structs = [
        F.struct(
            F.lit(position).alias("position"),
            F.lit(c).alias("original_name"),
            *[F.col(f"`{c}\x1f{i}`").alias(field) for i, field in enumerate(fields)],
        )
        for position, c in enumerate(df.columns, start=1)
    ]
    per_column = row.select(F.explode(F.array(*structs)).alias("c")).select("c.*")
    suggestion = F.when(F.col("filled") == 0, "VARCHAR")
    for kind, _ in SHAPES:
        target = F.when(F.col("wide"), "BIGINT").otherwise("INTEGER") if kind == "WHOLE" else F.lit(kind)
        suggestion = suggestion.when(F.col(kind), target)
    name = N.identifier(F.col("original_name"), F.col("position"))
    return per_column.select(
        "position",
        "original_name",
        name.alias("name"),
        suggestion.otherwise("VARCHAR").alias("type"),
        F.when(N.looks_personal(name), "sensitive").otherwise("public").alias("classification"),
    )


def review_error(reviewed: Mapping[str, tuple[str, str]], table_suffix: str) -> str | None:
    """First reason a reviewed column list {name: (type, classification)} cannot be loaded."""
    if not re.match(N.IDENTIFIER, table_suffix):
        return "invalid_table_suffix"
    for name, (kind, _) in reviewed.items():
        if not re.match(N.IDENTIFIER, name):
            return "invalid_column_name"
        if kind.upper() not in UPLOAD_TYPES:
            return "unsupported_column_type"
    if all(label != "public" for _, label in reviewed.values()):
        return "no_public_column"
    return None


def load_reviewed(df: DataFrame, reviewed: Mapping[str, tuple[str, str]], table_suffix: str) -> tuple[DataFrame, int, int]:
    """(public columns with their types, included, excluded); raises on an invalid review."""
    error = review_error(reviewed, table_suffix)
    if error:
        raise ValueError(error)
    public = {n: UPLOAD_TYPES[kind.upper()] for n, (kind, label) in reviewed.items() if label == "public"}
    return typed(df, public), len(public), len(reviewed) - len(public)


def review_report(columns: DataFrame) -> DataFrame:
    """Per upload the first error in column order, or none, and the two counts.

    ``columns``: upload_id, position, table_suffix, name, type, classification.
    """
    public = F.col("classification") == "public"
    error = F.when(~F.col("name").rlike(N.IDENTIFIER), "invalid_column_name").when(
        ~F.upper("type").isin(list(UPLOAD_TYPES)), "unsupported_column_type"
    )
    judged = columns.groupBy("upload_id").agg(
        F.max(~F.col("table_suffix").rlike(N.IDENTIFIER)).alias("bad_suffix"),
        F.min_by(error, F.when(error.isNotNull(), F.col("position"))).alias("column_error"),
        F.count_if(public).alias("included"),
        F.count_if(~public).alias("excluded"),
        (F.count("name") > F.count_distinct("name")).alias("doubled"),
    )
    return judged.select(
        "upload_id",
        F.when(F.col("bad_suffix"), "invalid_table_suffix")
        .when(F.col("column_error").isNotNull(), F.col("column_error"))
        .when(F.col("included") == 0, "no_public_column")
        .when(F.col("doubled"), "duplicate_column_name")
        .alias("error"),
        "included",
        "excluded",
    )


def upload_refusal(name: Column, size: Column, org_unit: Column) -> Column:
    """Why an upload is refused, or NULL."""
    return (
        F.when(size > N.UPLOAD_MAX_BYTES, "file_too_large")
        .when(~F.coalesce(org_unit.rlike(N.ORG_UNIT), F.lit(False)), "invalid_org_unit")
        .when(N.file_kind(name).isNull(), "unsupported_file_type")
    )


# Closed lists of a release request.
RELEASE_DOMAINS = ["student", "personnel", "research", "academic_services", "indicator"]
ACCESS_LEVELS = ["university", "restricted"]
CADENCES = ["manual", "daily", "weekly", "monthly"]
MAX_TAGS, MAX_TAG_CHARS = 10, 40
LONG_TEXTS = ["description", "description_en", "changelog"]


def release_requests(df: DataFrame) -> DataFrame:
    """Requests with trimmed texts, de-duplicated tags and the first reason they are invalid.

    ``df``: table_name, title, title_en, description, description_en, changelog, domain, owner_org_unit,
    access_level, refresh_cadence, tags (array), plus any key columns.
    """
    trim = lambda c: strip(F.col(c))
    table, owner = trim("table_name"), F.lower(trim("owner_org_unit"))
    text = lambda c, n: F.length(trim(c)) > n
    domain = F.nullif(trim("domain"), F.lit(""))
    level = F.coalesce("access_level", F.lit(ACCESS_LEVELS[0]))
    cadence = F.coalesce("refresh_cadence", F.lit(CADENCES[0]))
    raw_tags = F.coalesce("tags", F.array().cast("array<string>"))
    trimmed = F.transform(raw_tags, strip)
    bad_tag = F.exists(trimmed, lambda t: F.coalesce((F.length(t) == 0) | (F.length(t) > MAX_TAG_CHARS), F.lit(True)))
    false = F.lit(False)
    error = (
        F.when(~F.coalesce(table.rlike(N.TABLE_NAME), false), "invalid_table_name")
        .when(F.coalesce(F.length(trim("title")), F.lit(0)) == 0, "title_required")
        .when(text("title", 200), "title_required")
        .when(F.coalesce(text("title_en", 200), false), "invalid_text_field")
        .when(F.coalesce(F.greatest(*[F.length(trim(c)) for c in LONG_TEXTS]) > 2000, false), "invalid_text_field")
        .when(domain.isNotNull() & ~domain.isin(RELEASE_DOMAINS), "invalid_domain")
        .when(~F.coalesce(owner.rlike(N.ORG_UNIT), false), "invalid_owner_org_unit")
        .when(~level.isin(ACCESS_LEVELS), "invalid_access_level")
        .when(~cadence.isin(CADENCES), "invalid_refresh_cadence")
        .when((F.size(raw_tags) > MAX_TAGS) | bad_tag, "invalid_tags")
    )
    changed = {
        "table_name": table,
        "title": trim("title"),
        "title_en": F.nullif(trim("title_en"), F.lit("")),
        **{c: F.nullif(trim(c), F.lit("")) for c in LONG_TEXTS},
        "domain": domain,
        "owner_org_unit": owner,
        "access_level": level,
        "refresh_cadence": cadence,
        "tags": F.array_distinct(trimmed),
    }
    return df.select(
        *[changed[c].alias(c) if c in changed else F.col(c) for c in df.columns], error.alias("error")
    )
