"""Guards: source hosts, forbidden content, personal columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamlake.functions.text import redact_credentials

# Fixed value: what introduces a connection target.
TARGET_PREFIX = r"(://|[Hh]ost=|[Ss]erver=|[Dd]ata [Ss]ource=|jdbc:[a-z]+:)"


def host_name(raw: Column) -> Column:
    """Lower case, without quotes, blanks and port."""
    plain = F.lower(F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"[\r\"']", "")))
    return F.element_at(F.split(plain, ":"), 1)


def host_refusal(raw: Column, denied: Sequence[str], allowed: Sequence[str]) -> Column:
    """Why a host may not be read, or NULL. A denied name or a name below it wins over the allow list.

    Both lists are configuration of a few entries, so they are literals in the
    expression: no join, no shuffle.
    """
    host = host_name(raw)
    hits = F.lit(None).cast("string")
    for entry in reversed(list(denied)):
        hits = F.when((host == entry) | F.endswith(host, F.lit(f".{entry}")), entry).otherwise(hits)
    return (
        F.when(host == "", "no host configured")
        .when(hits.isNotNull(), F.concat(F.lit("host "), host, F.lit(" is denied by "), hits))
        .when(~host.isin(list(allowed)), F.concat(F.lit("host "), host, F.lit(" is not allowed")))
    )


def denied_hosts(hosts: DataFrame, denylist: DataFrame) -> DataFrame:
    """(host, entry) for a denylist of any size: an equi-join on the host's own suffixes."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    exploded = hosts.select("host").distinct().select("host", F.explode(suffixes).alias("entry"))
    return exploded.join(denylist.select("entry").distinct(), "entry").select("host", "entry")


def forbidden_targets(df: DataFrame, text: str, denied: Sequence[str], report: int | None = None) -> DataFrame:
    """Distinct connection targets per denied entry, credentials masked; all of them, or the first ``report``.

    Only the target is reported, up to the entry's last place in it, never the text around it. One pattern
    finds the candidates, whatever the number of entries; a candidate's pieces as long as some entry then meet
    the entries by equality. A target inside another one is a candidate too.
    """
    spark = df.sparkSession
    entries = spark.createDataFrame([(e, e.lower()) for e in dict.fromkeys(denied)], "entry string, _piece string")
    sizes = F.array(*[F.lit(n) for n in sorted({len(e) for e in denied})])
    found = F.regexp_extract_all(F.col(text), F.lit(rf"(?i)(?=({TARGET_PREFIX.replace('(', '(?:', 1)}[A-Za-z0-9._-]*))"), 1)
    # Few different targets, however many texts hold them.
    targets = df.select(F.explode(F.array_distinct(found)).alias("_found")).distinct()
    parted = targets.withColumn("_host", F.regexp_replace("_found", rf"(?i)^{TARGET_PREFIX}", ""))
    sized = parted.withColumn("_size", F.explode(sizes)).filter(F.length("_host") >= F.col("_size"))
    pieces = F.expr("transform(sequence(0, length(_host) - _size), i -> lower(substring(_host, i + 1, _size)))")
    met = sized.select("_found", "_host", "_size", F.posexplode(pieces).alias("_at", "_piece")).join(entries, "_piece")
    last = met.groupBy("entry", "_found", "_host", "_size").agg(F.max("_at").alias("_at"))
    upto = F.expr("left(_found, length(_found) - length(_host) + _at + _size)")
    masked = last.select("entry", redact_credentials(upto).alias("target")).distinct()
    if report is None:
        return masked
    nth = F.row_number().over(Window.partitionBy("entry").orderBy("target"))
    return masked.withColumn("_nth", nth).filter(F.col("_nth") <= report).drop("_nth")


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """The first listed word found in the text, upper or lower case, or NULL."""
    hit = F.lit(None).cast("string")
    for word in reversed(list(words)):
        hit = F.when(F.contains(F.lower(text), F.lit(word.lower())), word).otherwise(hit)
    return hit


def personal_columns(columns: DataFrame, names: Sequence[str], numeric_exempt: Sequence[str] = ()) -> DataFrame:
    """Catalog columns that must not be there; a listed name of a numeric type counts as a figure."""
    numeric = F.col("data_type").rlike("^(tinyint|smallint|int|bigint|float|double|decimal)")
    lowered = F.lower("column_name")
    return columns.filter(lowered.isin(list(names)) & ~(numeric & lowered.isin(list(numeric_exempt))))
