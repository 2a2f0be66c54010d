"""Identifiers, file names and object keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shapes names must have, and the words that mark a column as personal.
IDENTIFIER = r"^[a-z][a-z0-9_]*$"
TABLE_NAME = r"^[a-z][a-z0-9_]{0,127}$"
ORG_UNIT = r"^[a-z0-9_-]{1,64}$"
PERSONAL = r"(?i)(id|citizen|passport|ssn|name|phone|tel|email|salary|wage|gpa|birth|address|gender)"
# Names given to uploads whose own name has no ASCII letter or digit.
GENERIC_UPLOAD = {"csv": "data.csv", "pdf": "document.pdf", "docx": "document.docx"}
UPLOAD_MAX_BYTES = 50 * 1024 * 1024


def identifier(raw: Column, position: Column) -> Column:
    """A column name usable in SQL; ``position`` (from 1) names what has no letter to start with."""
    name = F.regexp_replace(F.regexp_replace(F.lower(raw), "[^a-z0-9_]", "_"), r"^_+|_+$", "")
    return F.when(name.rlike("^[a-z]"), name).otherwise(
        F.concat(F.lit("col_"), F.when(name != "", name).otherwise(position.cast("string")))
    )


def looks_personal(name: Column) -> Column:
    """Substring test, so ``width`` counts as personal: a reviewer decides, nothing leaks."""
    return name.rlike(PERSONAL)


def safe_file_name(name: Column) -> Column:
    """Letters, digits, dot, dash and underscore of any script; ``file`` when empty."""
    kept = F.regexp_replace(name, r"[^\p{L}\p{N}._-]", "_")
    return F.when(F.coalesce(F.length(name), F.lit(0)) == 0, F.lit("file")).otherwise(kept)


def file_kind(name: Column) -> Column:
    """csv, pdf or docx by suffix, otherwise NULL."""
    lowered = F.lower(name)
    kind = F.lit(None).cast("string")
    for suffix in reversed(list(GENERIC_UPLOAD)):
        kind = F.when(F.endswith(lowered, F.lit(f".{suffix}")), suffix).otherwise(kind)
    return kind


def object_leaf(name: Column) -> Column:
    """ASCII leaf of an upload's object key."""
    base = F.regexp_extract(name, r"([^/\\]*)\z", 1)
    cleaned = F.regexp_replace(F.when(base == "", F.lit("upload")).otherwise(base), "[^A-Za-z0-9._-]", "_")
    stem = F.regexp_replace(cleaned, r"\.[^.]*$", "")
    kind = file_kind(name)
    generic = F.lit(None).cast("string")
    for suffix, leaf in GENERIC_UPLOAD.items():
        generic = F.when(kind == suffix, leaf).otherwise(generic)
    return F.when(stem.rlike("[A-Za-z0-9]"), cleaned).otherwise(F.coalesce(generic, cleaned))


def object_key(org_unit: Column, upload_id: Column, name: Column) -> Column:
    """One directory per upload, so a directory scan reads one upload only."""
    return F.concat_ws("/", F.lit("staging/uploads"), org_unit, upload_id.cast("string"), object_leaf(name))


def extension(name: Column) -> Column:
    """Lower-case text after the last dot, empty without a dot."""
    return F.lower(F.regexp_extract(name, r"\.([^.]*)\z", 1))
