"""Source type names, target types and typed casts of staged text."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Source type -> Spark type. Numerics take one wide decimal
# whatever their declared scale; a type not listed stays a string.
EXACT_TYPES = {
    "smallint": "smallint",
    "int2": "smallint",
    "integer": "int",
    "int": "int",
    "int4": "int",
    "bigint": "bigint",
    "int8": "bigint",
    "real": "float",
    "float4": "float",
    "double precision": "double",
    "float8": "double",
    "boolean": "boolean",
    "bool": "boolean",
    "date": "date",
}
PREFIX_TYPES = [
    ("numeric", "decimal(38,9)"),
    ("decimal", "decimal(38,9)"),
    ("timestamp with time zone", "timestamp"),
    ("timestamp", "timestamp_ntz"),
]
# The closed type list of reviewed uploads.
UPLOAD_TYPES = {
    "VARCHAR": "string",
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "BOOLEAN": "boolean",
    "DATE": "date",
    "TIMESTAMP": "timestamp_ntz",
}


def spark_type(source_type: str | None) -> str:
    """Spark type of one source type name."""
    name = (source_type or "").strip().lower()
    if name in EXACT_TYPES:
        return EXACT_TYPES[name]
    return next((target for prefix, target in PREFIX_TYPES if name.startswith(prefix)), "string")


def spark_type_column(source_type: Column) -> Column:
    """:func:`spark_type` over a registry column."""
    name = F.trim(F.lower(F.coalesce(source_type, F.lit(""))))
    exact = F.create_map(*[F.lit(x) for pair in EXACT_TYPES.items() for x in pair])
    by_prefix = F.lit("string")
    for prefix, target in reversed(PREFIX_TYPES):
        by_prefix = F.when(F.startswith(name, F.lit(prefix)), target).otherwise(by_prefix)
    return F.coalesce(F.try_element_at(exact, name), by_prefix)


def mark_type(source_type: Column) -> Column:
    """How a high-water mark of this source type is compared: numeric, timestamp or text."""
    name = F.lower(F.coalesce(source_type, F.lit("")))
    return (
        F.when(name.rlike("int|numeric|decimal|real|double"), "numeric")
        .when(name.rlike("timestamp|date"), "timestamp")
        .otherwise("text")
    )


def staged_cast(column: Column, target: str) -> Column:
    """Empty text is NULL in every type; any other bad value fails the load (ANSI cast)."""
    return F.nullif(column, F.lit("")).cast(target)


def typed(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Project exactly the named columns of staged text to their Spark types."""
    return df.select([staged_cast(F.col(f"`{name}`"), target).alias(name) for name, target in types.items()])


def split_castable(df: DataFrame, types: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """(typed rows, rejected rows with the failing column names): failures are routed, not dropped."""
    failing = F.array_compact(
        F.array(
            *[
                F.when(
                    F.nullif(F.col(f"`{n}`"), F.lit("")).isNotNull() & F.col(f"`{n}`").try_cast(t).isNull(), F.lit(n)
                )
                for n, t in types.items()
            ]
        )
    )
    marked = df.withColumn("_failing", failing)
    good = marked.filter(F.size("_failing") == 0).select(
        [F.nullif(F.col(f"`{n}`"), F.lit("")).try_cast(t).alias(n) for n, t in types.items()]
    )
    return good, marked.filter(F.size("_failing") > 0)


def all_strings(names: Iterable[str]) -> str:
    """Schema of a staging table: every column is text."""
    return ", ".join(f"`{n}` string" for n in names)
