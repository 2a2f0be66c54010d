"""The registered queries and the pipeline over the smallest given tables."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from loamlake.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no given tables")

COLUMNS = {
    "op1_language": "doc_id held_out lang_pred score",
    "op2_ngram_jaccard_join": "doc_id n_shingles component_id",
    "op3_token_file": "doc_id start n_tokens ids_crc32",
    "op4_order_minhash": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op5_toxicity": "doc_id held_out score predicted",
    "op6_benchmark_decontamination": "doc_id leaked item_id",
    "op7_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op8_url_filters": "page_id host path rule verdict",
    "op9_license_scans": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op10_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op11_merkle_manifest": "doc_id leaf subroot root proof_sha256 folded_root verified",
    "op12_ranked_lexical_search": "item_id rank doc_id score",
    "op13_simhash_near_dedup": "doc_id fingerprint component_id",
}


def test_all_are_registered():
    assert set(QUERIES) == set(COLUMNS) and {*COLUMNS, "pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    table, key = {"op8_url_filters": ("pages", "page_id"), "op12_ranked_lexical_search": ("benchmark", "item_id")}.get(name, ("documents", "doc_id"))
    keys = {r[0] for r in spark.read.parquet(f"{FOLDER}/{table}.parquet").select(key).collect()}
    got = [r[0] for r in df.select(key).collect()]
    assert set(got) == keys and (name in ("op10_packing", "op12_ranked_lexical_search") or len(got) == len(keys))


def test_held_out_accuracy(spark):
    truth = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    right = QUERIES["op1_language"](spark, FOLDER).filter("held_out").join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97


def test_order_minhash_edits(spark):
    rows = sorted(((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()), reverse=True)
    got = {r["doc_id"]: r for r in QUERIES["op4_order_minhash"](spark, FOLDER).collect()}
    for (key, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert got[key]["n_chars"] == len(text) and got[key]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()


def test_leaks_are_the_documents_that_hold_items(spark):
    items = [" ".join(r["text"].split()) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    holding = {r["doc_id"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect() if any(i in " ".join(r["text"].split()) for i in items)}
    leaked = {r["doc_id"] for r in QUERIES["op6_benchmark_decontamination"](spark, FOLDER).filter("leaked").collect()}
    assert holding <= leaked


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    made = corpus_pipeline.run(spark, FOLDER)
    left = {r["doc_id"] for r in made.select("doc_id").collect()}
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").filter("toxic = 1").collect()}
    assert left < {r["doc_id"] for r in docs.collect()} and len(left) > 0.6 * docs.count()
    assert len(left & toxic) < len(toxic)
    assert made.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0


def test_stages_take_empty_and_awkward_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = docs.limit(3).unionByName(docs.limit(3)).unionByName(docs.select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("text"), "lang", "source", F.lit(None).cast("bigint").alias("n_chars")).limit(2))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
        clashing = ["_row", "_score", "leaked", "item_id", "n_items", "cosine", "common", "answer", "score", "_kept0"]
        made = stage(spark, odd.withColumns({c: F.lit(1) for c in clashing}), FOLDER)
        if name != "packing":
            assert made.columns == [*odd.columns, *clashing] and made.count() <= odd.count()
        if name == "ngram_jaccard_join":
            assert made.count() == 5 and {r["_row"] for r in made.collect()} == {1}
