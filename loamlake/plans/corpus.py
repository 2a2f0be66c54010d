"""The corpus job: records -> clean -> new texts only -> deduplicate -> budget -> shards -> manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamlake.functions.text import dedup_key
from loamlake.operators.bitmap import left_anti
from loamlake.operators.corpus import clean_records, dedup_stats, without_datasets
from loamlake.operators.neardup import band_buckets, bucket_rows, near_rows
from loamlake.operators.running import budgeted_shards
from loamlake.runtime import cut_lineage, path_exists
from loamlake.sinks.corpus import SHARD_CHARS, write_manifest, write_shards, write_sidecar
from loamlake.sources.shards import BANDS, KEYS, read_manifest, read_sidecar, without_sidecar

TARGET_CHARS = 1_000_000_000
KEY_COLUMNS = ["_key", "char_count", "source", "dataset_id", "dataset_name", "topic"]


def run(
    spark: SparkSession,
    records: DataFrame,
    root: str,
    *,
    order: Sequence[str] = ("doc_id",),
    target: int = TARGET_CHARS,
    fuzzy: bool = False,
    resume: bool = False,
    skipped: Sequence[str] = (),
    shard_chars: int = SHARD_CHARS,
    **rules,
) -> None:
    """Run the job; with ``resume`` only what earlier shards lack is added, within what is left of the budget.

    Texts are cleaned once into a staged copy that also holds their key. Which
    records are new, first of their kind and within the budget, and their
    shard, is decided on keys and lengths alone; texts then meet that decision
    in one join. What is written is known from the sidecars of its shards, never from its texts. A crash loses no more
    than the shards Spark had not committed: the next resume adds the sidecars that are missing and goes on.
    """
    done, written, taken = (0, 0), None, None
    if resume and path_exists(spark, root):
        complete(spark, root, fuzzy)
        written = read_sidecar(spark, root, KEYS)
        taken = read_sidecar(spark, root, BANDS) if fuzzy else None
        done = written.agg(F.count("*"), F.coalesce(F.sum("char_count"), F.lit(0))).first()
        if done[1] >= target:
            return
    clean = clean_records(without_datasets(records, skipped), **rules)
    staged = cut_lineage(clean.withColumn("_key", dedup_key(F.col("text"))), "clean")
    first = cut_lineage(new_keys(staged, order, written, done[0]), "new")
    bands = cut_lineage(band_rows(staged, first, order), "bands") if fuzzy else None
    chosen = cut_lineage(first.join(near_rows(bands, taken).select("id.*"), list(order), "left_anti"), "chosen") if fuzzy else first
    placed = cut_lineage(budgeted_shards(chosen, "char_count", order, target - done[1], shard_chars), "placed")
    stats = dedup_stats(staged, written, F.col("_key"))
    if fuzzy:
        stats = stats.withColumn("near_kept", chosen.agg(F.count("*")).scalar())
    stats = cut_lineage(stats)
    made = write_shards(staged.drop("_key").join(placed, list(order)), root, list(order), shard_chars)
    index = staged.select(*[c for c in KEY_COLUMNS if c in staged.columns], *[c for c in order if c not in KEY_COLUMNS]).join(placed, list(order))
    write_sidecar(index.select(*[F.col(c) if c in index.columns else F.lit(None).cast("string").alias(c) for c in KEY_COLUMNS], "shard"), root, KEYS, made["first"], made["shards"])
    if fuzzy:
        write_sidecar(bands.select("id.*", "bucket").join(placed, list(order)).select("bucket", "shard"), root, BANDS, made["first"], made["shards"])
    rows, chars = done[0] + made["rows"], done[1] + made["chars"]
    totals = stats.select(
        F.lit(rows).cast("bigint").alias("total_rows"), F.lit(chars).cast("bigint").alias("total_chars"), F.lit(target).cast("bigint").alias("target"),
        F.lit(chars >= target).alias("target_reached"), F.struct(*stats.columns).alias("dedup"),
    )
    write_manifest(spark, root, totals)


def complete(spark: SparkSession, root: str, fuzzy: bool = False) -> None:
    """Add the sidecars of shards that have none: a run broke off before it wrote them, or one without bands wrote the shards."""
    for name in (KEYS, BANDS) if fuzzy else (KEYS,):
        bare = without_sidecar(spark, root, name)
        if bare is None:
            continue
        if name == KEYS:
            made = bare.withColumn("_key", dedup_key(F.col("text"))).select(*[F.col(c) if c in [*bare.columns, "_key"] else F.lit(None).cast("string").alias(c) for c in KEY_COLUMNS], "shard")
        else:
            made = bare.select(F.explode(band_buckets(F.col("text"))).alias("bucket"), "shard")
        made = cut_lineage(made, "sidecar")
        shards = made.agg(F.countDistinct("shard")).first()[0]
        if shards:
            write_sidecar(made, root, name, 0, shards)


def new_keys(staged: DataFrame, order: Sequence[str], written: DataFrame | None = None, count: int = 0) -> DataFrame:
    """``order`` and ``char_count`` of the first record of every ``_key`` of ``staged`` that is not among the ``count`` of ``written``."""
    row = F.struct(*order, "char_count")
    first = staged.select("_key", row.alias("_row")).groupBy("_key").agg(F.min("_row").alias("_row"))
    if written is not None:
        first = left_anti(cut_lineage(first, "first"), written, "_key", count)
    return first.select("_row.*")


def band_rows(staged: DataFrame, chosen: DataFrame, order: Sequence[str]) -> DataFrame:
    """(id, bucket) of the chosen records; the whole order is a text's id and decides which copy is the first."""
    texts = staged.join(chosen.select(*order), list(order), "left_semi").select(F.struct(*order).alias("_at"), "text")
    return bucket_rows(texts, "_at")


def kept_per_file(records: DataFrame, kept: DataFrame, file: str = "file") -> DataFrame:
    """Kept records per input file, files without any included."""
    counts = kept.groupBy(file).agg(F.count("*").alias("kept"))
    return records.select(file).distinct().join(counts, file, "left").select(file, F.coalesce("kept", F.lit(0)).alias("kept"))


def already_reached(spark: SparkSession, root: str) -> bool:
    """Whether the last run's manifest says the budget was reached."""
    manifest = read_manifest(spark, root)
    return bool(manifest is not None and manifest.select("target_reached").first()[0])
