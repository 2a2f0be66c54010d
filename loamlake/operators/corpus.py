"""Corpus operators: record building, cleaning, exact deduplication, totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamlake.functions import text as X
from loamlake.operators.once import with_once

RECORD = T.StructType(
    [
        T.StructField(name, T.LongType() if name == "char_count" else T.StringType())
        for name in (
            "source",
            "dataset_id",
            "dataset_name",
            "topic",
            "license",
            "doc_id",
            "text",
            "char_count",
            "fetched_at",
        )
    ]
)
# Columns a text or an id is looked for in, by preference.
TEXT_COLUMNS = ["text", "content", "body", "message", "paragraph", "doc", "raw"]
ID_COLUMNS = ["id", "_id", "uid", "doc_id", "document_id", "hash"]
LONG_TEXT = 40


def pick_text(df: DataFrame) -> Column:
    """First named text column that is not blank, else the first string column longer than 40 characters."""
    types = dict(df.dtypes)
    named = [c for c in TEXT_COLUMNS if types.get(c) == "string"]
    strings = [c for c, t in df.dtypes if t == "string"]
    choices = [F.when(X.strip(F.col(f"`{c}`")) != "", F.col(f"`{c}`")) for c in named]
    choices += [F.when(F.length(F.col(f"`{c}`")) > LONG_TEXT, F.col(f"`{c}`")) for c in strings]
    return F.coalesce(*choices) if choices else F.lit(None).cast("string")


def pick_id(df: DataFrame, text: Column) -> Column:
    """First filled id column as text, else the text's MD5."""
    choices = [F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")) for c in ID_COLUMNS if c in df.columns]
    return F.coalesce(*choices, F.md5(text))


def to_records(
    df: DataFrame,
    *,
    source: str,
    dataset_id: str,
    dataset_name: str,
    topic: str = "",
    license: str = "",
    fetched_at: str = "",
) -> DataFrame:
    """Rows of any shape as corpus records stamped with their dataset; rows without text go."""
    found = with_once(df, {"_text": pick_text(df)})
    picked = found.select(F.col("_text").alias("text"), pick_id(df, F.col("_text")).alias("doc_id"))
    return picked.filter(F.col("text") != "").select(
        F.lit(source).alias("source"),
        F.lit(dataset_id).alias("dataset_id"),
        F.lit(dataset_name).alias("dataset_name"),
        F.lit(topic).alias("topic"),
        F.lit(license).alias("license"),
        "doc_id",
        "text",
        F.length("text").cast("bigint").alias("char_count"),
        F.lit(fetched_at).alias("fetched_at"),
    )


def clean_records(
    df: DataFrame,
    *,
    min_chars: int = 200,
    min_share: float = 0.30,
    script: tuple[str, str] = X.THAI,
    strip_html: bool = True,
    strip_urls: bool = False,
    strip_emails: bool = False,
) -> DataFrame:
    """Clean ``text``, drop what is too short or too little of the script, reset ``char_count``."""
    text = X.clean_text(F.col("text"), strip_html=strip_html, strip_urls=strip_urls, strip_emails=strip_emails)
    cleaned = with_once(df, {"text": text}).withColumn("char_count", F.length("text").cast("bigint"))
    return cleaned.filter((F.col("char_count") >= min_chars) & (X.script_share(F.col("text"), *script) >= min_share))


def first_rows(df: DataFrame, key: Column, order: Sequence[str]) -> DataFrame:
    """The ``order`` columns of the first row of every key.

    Works on (key, order) alone with partial aggregation, so a key shared by a
    third of all texts sends one small row per task.
    """
    if len(order) == 1:  # a plain minimum aggregates by hash, a struct's by sorting
        return df.select(key.alias("_key"), *order).groupBy("_key").agg(F.min(order[0]).alias(order[0])).select(order[0])
    keyed = df.select(key.alias("_key"), F.struct(*order).alias("_order"))
    return keyed.groupBy("_key").agg(F.min("_order").alias("_order")).select("_order.*")


def keep_first(df: DataFrame, key: Column, order: Sequence[str]) -> DataFrame:
    """The first row of every key in ``order``, which must identify a row.

    Whole rows meet the winners on the unique order columns, never on the key.
    """
    return df.join(first_rows(df, key, order), list(order), "left_semi")


def exact_dedup(df: DataFrame, order: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """Keep the first of all texts that differ only in case and white space."""
    return keep_first(df, X.dedup_key(F.col(text)), order)


def not_yet_written(df: DataFrame, written: DataFrame, order: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Rows whose text is not among the already written ones (resume).

    Keys meet keys on thin rows; whole rows are then picked by their unique order.
    """
    seen = written.filter(F.col("text") != "").select(X.dedup_key(F.col("text")).alias("_key")).distinct()
    fresh = df.select(*order, X.dedup_key(F.col("text")).alias("_key")).join(seen, "_key", "left_anti")
    return df.join(fresh.select(*order), list(order), "left_semi")


def dedup_stats(df: DataFrame, written: DataFrame | None = None, key: Column | None = None) -> DataFrame:
    """One row: texts dropped as exact copies, and distinct texts seen (written ones included).

    With ``key`` both inputs have it and no text is read.
    """
    by_text = X.dedup_key(F.col("text")) if key is None else key
    marked = df.select(by_text.alias("_key"), F.lit(1).alias("_new"))
    if written is not None:
        seen = written if key is not None else written.filter(F.col("text") != "")
        marked = marked.unionByName(seen.select(by_text.alias("_key"), F.lit(0).alias("_new")))
    per_key = marked.groupBy("_key").agg(F.sum("_new").alias("_n"), F.min("_new").alias("_was"))
    return per_key.agg(
        F.coalesce(F.sum(F.when(F.col("_was") == 0, F.col("_n")).otherwise(F.col("_n") - 1)), F.lit(0)).alias(
            "exact_dropped"
        ),
        F.count("*").alias("unique_kept"),
    )


def dataset_totals(df: DataFrame) -> DataFrame:
    """Rows and characters per ``source:dataset_id``."""
    key = F.concat_ws(":", "source", "dataset_id").alias("dataset")
    return df.groupBy(key).agg(
        F.min("dataset_name").alias("dataset_name"),
        F.min("topic").alias("topic"),
        F.count("*").alias("rows"),
        F.sum("char_count").alias("chars"),
    )


def without_datasets(df: DataFrame, skipped: Sequence[str]) -> DataFrame:
    """Leave out listed datasets."""
    return df.filter(~F.col("dataset_id").isin(list(skipped))) if skipped else df


def funnel(
    df: DataFrame, order: Sequence[str] = ("doc_id",), group: str = "source", **rules
) -> DataFrame:
    """Per group: rows read, rows left after cleaning and deduplication, and their characters.

    Texts are read once and end in their key; only the key, the order and the
    figures of the first row per key are shuffled.
    """
    read = df.groupBy(group).agg(F.count("*").alias("rows_in"))
    clean = clean_records(df, **rules)
    row = F.struct(*order, F.col(group).alias("_group"), "char_count")
    first = clean.select(X.dedup_key(F.col("text")).alias("_key"), row.alias("_row")).groupBy("_key").agg(F.min("_row").alias("r"))
    left = first.groupBy(F.col("r._group").alias(group)).agg(F.count("*").alias("rows_kept"), F.sum("r.char_count").alias("chars"))
    return read.join(left, group, "left").select(
        group,
        "rows_in",
        F.coalesce("rows_kept", F.lit(0)).alias("rows_kept"),
        F.coalesce("chars", F.lit(0)).alias("chars"),
    )
