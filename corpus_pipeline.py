"""The training-corpus pipeline: toxic documents go, near copies go, repeated passages go, leaked benchmark items go, the rest is packed.

Each stage reads what the one before wrote. ``sf_dir`` gives the tables the
stages learn from or search for: labels and benchmark.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamlake.llm import decontam, jaccard, packing, suffixes, toxicity
from loamlake.llm.blocks import small_batches
from loamlake.runtime import cut_lineage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, labels)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity 0.8; the one with the least doc_id stays."""
    small_batches(spark)
    return jaccard.keep_one(docs, k=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 200-byte strings that stand anywhere else; ``n_chars`` follows."""
    small_batches(spark)
    made = suffixes.remove_repeats(docs)
    return made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else made


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; columns of any name are passed on."""
    small_batches(spark)
    kept = [c if c == "text" else f"_kept{i}" for i, c in enumerate(docs.columns)]
    judged = decontam.judge(docs.toDF(*kept), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return judged.filter("NOT leaked").select(*kept).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of the packed sequences, ids included."""
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 1, ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_leaked),
    ("packing", pack),
]
# No stage but joins and filters on what SQL could say: models, fixed points and packings are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return docs
