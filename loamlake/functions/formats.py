"""Ages, sizes, times and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weekday labels, Monday first.
THAI_WEEKDAYS = ["จันทร์", "อังคาร", "พุธ", "พฤหัสบดี", "ศุกร์", "เสาร์", "อาทิตย์"]


def iso_utc(ts: Column) -> Column:
    """``2024-01-31T09:05:00Z``."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def seconds_between(start: Column, end: Column) -> Column:
    """Exact seconds as a decimal; works on timestamps with and without zone."""
    micros = F.timestamp_diff("MICROSECOND", start, end)
    return micros.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")


def age_hours(ts: Column, as_of: Column) -> Column:
    """Hours since ``ts`` with one decimal."""
    return F.round(seconds_between(ts, as_of) / F.lit(3600).cast("decimal(4,0)"), 1).cast("decimal(12,1)")


def age_parts(ts: Column, as_of: Column) -> tuple[Column, Column]:
    """(unit, count) of a human age. Each unit is rounded from the one below it."""
    half_up = lambda c: F.floor(c + 0.5)
    minutes = half_up(F.timestamp_diff("MICROSECOND", ts, as_of) / 60_000_000)
    hours = half_up(minutes / 60)
    unit = (
        F.when(ts.isNull(), "never").when(minutes < 60, "minutes").when(hours < 24, "hours").otherwise("days")
    )
    count = (
        F.when(ts.isNull(), F.lit(None))
        .when(minutes < 60, F.greatest(minutes, F.lit(0)))
        .when(hours < 24, hours)
        .otherwise(half_up(hours / 24))
    )
    return unit, count.cast("bigint")


def human_bytes(size: Column) -> Column:
    """``0 B``, ``900 B``, ``1.5 KB``, ``12 MB`` ... up to GB."""
    out = F.when(size >= 1024**3, _scaled(size, 1024**3, "GB"))
    out = out.when(size >= 1024**2, _scaled(size, 1024**2, "MB")).when(size >= 1024, _scaled(size, 1024, "KB"))
    return out.when(size > 0, F.concat(F.round(size, 0).cast("bigint").cast("string"), F.lit(" B"))).otherwise("0 B")


def _scaled(size: Column, base: int, unit: str) -> Column:
    value = size / base
    number = F.when(value >= 10, F.round(value, 0).cast("decimal(20,0)").cast("string")).otherwise(
        F.round(value, 1).cast("decimal(20,1)").cast("string")
    )
    return F.concat(number, F.lit(f" {unit}"))


def local_time(ts: Column, zone: str = "Asia/Bangkok") -> Column:
    """UTC instant as wall-clock time of ``zone``."""
    return F.from_utc_timestamp(ts.cast("timestamp"), zone).cast("timestamp_ntz")


def month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def weekday_label(number: Column, labels: list[str] | None = None) -> Column:
    """Label of weekday ``number`` (0 = Monday)."""
    return F.element_at(F.array(*map(F.lit, labels or THAI_WEEKDAYS)), (number + 1).cast("int"))


def first_filled(*choices: Column) -> Column:
    """First value that is neither NULL nor empty (label fallback across languages)."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in choices])


def pseudonym(value: Column) -> Column:
    """SHA-256 stand-in for a token or an account name."""
    return F.sha2(value.cast("string"), 256)
