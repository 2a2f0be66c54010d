"""Searches and list filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def matches_terms(query: str, fields: Sequence[Column]) -> Column:
    """Every blank-separated term occurs somewhere in the joined fields, whatever the case."""
    haystack = F.lower(F.concat_ws(" ", *[F.nullif(f, F.lit("")) for f in fields]))
    verdict = F.lit(True)
    for term in query.lower().split():
        verdict = verdict & F.contains(haystack, F.lit(term))
    return verdict


def any_field_contains(query: str, fields: Sequence[Column]) -> Column:
    """One field contains the trimmed query, whatever the case; an empty query matches all."""
    wanted = query.strip().lower()
    verdict = F.lit(not wanted)
    for field in fields:
        verdict = verdict | F.contains(F.lower(F.coalesce(field, F.lit(""))), F.lit(wanted))
    return verdict


def in_status(status: Column, wanted: str) -> Column:
    """A load under way still counts as waiting for review."""
    return (status == wanted) | ((status == "loading") & F.lit(wanted == "pending_review"))


def status_counts(status: Column, tabs: Sequence[str]) -> list[Column]:
    """One count per list tab, for a single aggregation."""
    return [F.count_if(in_status(status, tab)).alias(tab) for tab in tabs]


def since(ts: Column, as_of: Column, interval: str) -> Column:
    """Later than ``as_of`` minus the interval."""
    return ts > as_of - F.expr(f"INTERVAL {interval}")
