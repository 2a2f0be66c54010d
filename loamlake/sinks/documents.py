"""CSV extracts and the catalogue document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamlake.operators.guard import contains_any
from loamlake.sinks.folders import remove, settle, staged_beside, swap_in


def csv_cell(value: Column) -> Column:
    """NULL as nothing; commas, quotes and line ends quoted, quotes doubled."""
    text = value.cast("string")
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(text.rlike('[",\r\n]'), quoted).otherwise(text), F.lit(""))


def csv_lines(df: DataFrame) -> DataFrame:
    """Rows as CSV lines in column order."""
    cells = [csv_cell(F.col(f"`{c}`")) for c in df.columns]
    joined = cells[0]
    for cell in cells[1:]:
        joined = F.concat(joined, F.lit(","), cell)
    return df.select(joined.alias("line"))


def write_csv(df: DataFrame, folder: str) -> None:
    """CSV files with a header, readable by :func:`loamlake.sources.tables.read_staged`."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(folder)


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON object per row, NULLs kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def refuse_words(df: DataFrame, words: Sequence[str], text: str = "json") -> DataFrame:
    """Rows that hold a word which must never be published."""
    return df.select(contains_any(F.col(text), words).alias("word"), text).filter("word IS NOT NULL")


def write_catalogue(stats: DataFrame, domains: DataFrame, datasets: DataFrame, folder: str, words: Sequence[str]) -> None:
    """Catalogue as JSON lines of three kinds; refused as a whole when a forbidden word appears.

    It is written once, to a fresh folder beside ``folder``; that copy is checked and then moved into place, so
    what was checked is what is published. Whatever fails before leaves the old catalogue.
    """
    spark = stats.sparkSession
    settle(spark, folder)
    document = None
    for kind, part in (("stats", stats), ("domain", domains), ("dataset", datasets)):
        rows = json_rows(part).select(F.lit(kind).alias("kind"), "json")
        document = rows if document is None else document.unionByName(rows)
    staged = staged_beside(folder)
    document.select(F.concat(F.lit('{"'), "kind", F.lit('":'), "json", F.lit("}")).alias("value")).write.text(staged)
    found = refuse_words(spark.read.text(staged), words, "value").select("word").distinct().sort("word").first()
    if found:
        remove(spark, staged)
        raise ValueError(f"refusing to publish: output contains {found.word!r}")
    swap_in(spark, staged, folder)
