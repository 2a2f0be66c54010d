import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loamlake.operators import corpus as C
from loamlake.operators import bitmap, neardup, running
from loamlake.operators.skew import lookup
from loamlake.plans import corpus as plan
from loamlake.runtime import scratch_dir
from loamlake.sinks import corpus as sink
from loamlake.sources import shards


def docs(spark, texts):
    return spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, char_count bigint")


def test_first_copy_is_kept(spark):
    kept = C.exact_dedup(docs(spark, ["A b", "c", " a  B\n", "C", "d"]).repartition(3))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 4]


def test_hot_key_keeps_one(spark):
    kept = C.exact_dedup(docs(spark, ["same"] * 400 + [f"t{i}" for i in range(800)]).repartition(8))
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {0} | set(range(400, 1200))


def test_running_sum_with_hot_key(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else rng.choice("abc"), i, rng.randint(0, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint").repartition(7)
    got = {(r.k, r.o): r.before for r in running.running_sum(df, F.col("v"), ["o"], ["k"], slices=8).collect()}
    sums, want = {}, {}
    for k, o, v in rows:
        want[k, o] = sums.get(k, 0)
        sums[k] = sums.get(k, 0) + v
    assert got == want


def test_running_sum_null_key(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "k string, o bigint")
    assert {(r.k, r.o, r.position) for r in running.row_number(df, ["o"], ["k"]).collect()} == {(None, 1, 1), (None, 2, 2), ("a", 1, 1)}


def test_budget_overshoots_by_one_record(spark):
    df = docs(spark, ["aaaaa"] * 3)
    kept = lambda n: sorted(r.doc_id for r in running.within_budget(df, "char_count", ["doc_id"], n).collect())
    assert kept(7) == [0, 1] and kept(5) == [0] and kept(0) == [] and kept(99) == [0, 1, 2]


def test_shards_follow_running_size(spark):
    placed = running.assign_shards(docs(spark, ["x" * n for n in (4, 4, 4, 10, 1)]), "char_count", ["doc_id"], 10)
    assert {r.doc_id: r.shard for r in placed.collect()} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 2}


def shards_by_loop(sizes, full):
    shard, chars, out = 0, 0, []
    for n in sizes:
        out.append(shard)
        chars += n
        if chars >= full:
            shard, chars = shard + 1, 0
    return out


@pytest.mark.parametrize("full,largest", [(10, 4), (25, 60), (400, 3)])
def test_restarting_count_equals_a_loop(spark, full, largest):
    rng = random.Random(full)
    sizes = [rng.choice([0, 0, rng.randint(0, largest)]) for _ in range(700)] + [0, 0]
    df = spark.createDataFrame([(i, "k", n) for i, n in enumerate(sizes)], "o bigint, p string, n bigint").repartition(6)
    for slices, together in ((1, 0), (9, 0), (9, 1 << 20)):
        placed = running.budgeted_shards(df, "n", ["o", "p"], None, full, slices=slices, together=together)
        assert [r.shard for r in sorted(placed.collect())] == shards_by_loop(sizes, full)


def test_restarting_count_at_the_edges(spark):
    for sizes in ([], [0, 0, 0], [10, 0, 0], [10, 10]):
        df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "o bigint, n bigint")
        placed = running.budgeted_shards(df, "n", ["o"], None, 10, slices=3)
        assert [r.shard for r in sorted(placed.collect())] == shards_by_loop(sizes, 10)


def test_lookup_equals_join(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"k{i}") for i in range(4000)], "id bigint, k string")
    table = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 4000, 2)], "k string, v bigint")
    for how in ("inner", "left"):
        got = sorted((r.id, r.v or -1) for r in lookup(rows, table, "k", how).collect())
        want = sorted((r.id, r.v or -1) for r in rows.join(table, "k", how).collect())
        assert got == want


def greedy(pairs):
    buckets, kept = {}, {}
    for i, b in pairs:
        buckets.setdefault(i, set()).add(b)
    seen, dropped = set(), set()
    for i in sorted(buckets):
        if buckets[i] & seen:
            dropped.add(i)
        else:
            seen |= buckets[i]
    return dropped


def test_rounds_equal_sequential_greedy(spark):
    rng = random.Random(11)
    for hot in (False, True):
        pairs = {(i, rng.randint(0, 150)) for i in range(200) for _ in range(2)}
        if hot:
            pairs |= {(i, 999) for i in range(0, 200, 3)}
        rows = spark.createDataFrame([(i, bytes([b % 256, b // 256])) for i, b in pairs], "id bigint, bucket binary")
        assert {r.id for r in neardup.dropped_ids(rows).collect()} == greedy(pairs)


def test_batches_equal_sequential_greedy(spark):
    """More open texts than one batch takes: rounds, components and batches of each."""
    rng = random.Random(5)
    pairs = {(i, f"chain{i // 60}-{(i + j) % 997}") for i in range(240) for j in (0, 1)} | {(i, f"b{rng.randint(0, 80)}") for i in range(0, 240, 5)}
    rows = spark.createDataFrame([(i, b.encode()) for i, b in sorted(pairs)], "id bigint, bucket binary")
    assert {r.id for r in neardup.dropped_ids(rows, 30).collect()} == greedy(pairs)


def test_a_long_chain_ends_in_few_rounds(spark, monkeypatch):
    """Ten thousand versions, each near the one before; alone and among enough others that rounds are needed."""
    rounds = []
    counted = neardup.cut_lineage
    monkeypatch.setattr(neardup, "cut_lineage", lambda df: rounds.append(1) or counted(df))
    chain = spark.range(10_000).select("id", F.explode(F.array("id", F.col("id") + 1)).alias("bucket"))
    assert neardup.dropped_ids(chain).filter("id % 2 = 1").count() == 5000 and len(rounds) < 5
    rounds.clear()
    assert neardup.dropped_ids(chain, 6000).filter("id % 2 = 1").count() == 5000 and len(rounds) < 30


def test_struct_ids_keep_their_order(spark):
    rows = spark.createDataFrame([((2, "a"), b"x"), ((10, "a"), b"x"), ((2, "b"), b"y")], "id struct<n:bigint,s:string>, bucket binary")
    assert [tuple(r.id) for r in neardup.dropped_ids(rows).collect()] == [(10, "a")]


def test_chain_keeps_both_ends(spark):
    rows = spark.createDataFrame([(1, b"x"), (2, b"x"), (2, b"y"), (3, b"y")], "id bigint, bucket binary")
    assert {r.id for r in neardup.dropped_ids(rows).collect()} == {2}


def test_band_layout():
    assert neardup.band_layout(0.8, 128) == (9, 13)


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(5)
    base = ["".join(rng.choices("abcdefghij klmnop", k=3000)) for _ in range(30)]
    near = [t[:1500] + "Q" + t[1500:] for t in base]
    df = docs(spark, base + near + [t.upper() for t in base])
    kept = {r.doc_id for r in neardup.near_dedup(df).collect()}
    assert set(range(30)) <= kept and len(kept & set(range(30, 60))) <= 2 and not kept & set(range(60, 90))
    fresh = neardup.near_dedup(docs(spark, near), written=docs(spark, base).select("text"))
    assert fresh.count() <= 2


def test_gram_hashes_tell_grams_apart():
    assert len(neardup.gram_hashes("abcdeabcde", 5)) == 5
    assert len(neardup.gram_hashes("ab", 5)) == 1 and len(neardup.gram_hashes("", 5)) == 0
    rng = random.Random(2)
    text = "".join(rng.choices("abcdก\U0001d11e", k=5000))
    assert len(neardup.gram_hashes(text, 5)) == len({text[i : i + 5] for i in range(len(text) - 4)})


def test_pick_text_and_id(spark):
    df = spark.createDataFrame([(" ", "body text", "x", 7), (None, None, "y" * 41, None)], "text string, body string, other string, id bigint")
    rows = C.to_records(df, source="s", dataset_id="d", dataset_name="n").collect()
    assert [r.text for r in rows] == ["body text", "y" * 41]
    assert rows[0].doc_id == "7" and len(rows[1].doc_id) == 32


def records(spark, texts):
    df = docs(spark, texts).withColumn("arrival", F.col("doc_id")).withColumn("doc_id", F.col("doc_id").cast("string"))
    for c in ("source", "dataset_id", "dataset_name", "topic", "license", "fetched_at"):
        df = df.withColumn(c, F.lit("given"))
    return df


def test_run_resume_and_manifest(spark):
    root = scratch_dir(spark, "test-corpus")
    texts = [f"text number {i} " + "word " * 60 for i in range(40)]
    rules = {"order": ["arrival"], "script": ("A", "z"), "shard_chars": 1000}
    plan.run(spark, records(spark, texts + texts[:5]), root, target=3000, **rules)
    first = {r.doc_id for r in shards.written_records(spark, root).collect()}
    assert 0 < len(first) < 40 and plan.already_reached(spark, root)
    plan.run(spark, records(spark, texts), root, target=10**9, resume=True, **rules)
    assert sorted(int(r.doc_id) for r in shards.written_records(spark, root).collect()) == list(range(40))
    manifest = shards.read_manifest(spark, root).first()
    assert manifest.total_rows == 40 and manifest.target_reached is False and manifest.dedup.exact_dropped == len(first)
    listed = sorted(r.shard for r in shards.list_shards(spark, root).collect())
    assert listed == list(range(len(listed))) and shards.next_shard(spark, root) == len(listed)


def test_resume_reads_sidecars_and_no_written_text(spark):
    root = scratch_dir(spark, "test-sidecars")
    texts = [f"text number {i} " + "word " * 60 for i in range(12)]
    rules = {"order": ["arrival"], "script": ("A", "z"), "shard_chars": 1000, "fuzzy": True}
    plan.run(spark, records(spark, texts[:8]), root, **rules)
    for path in Path(root).glob("shard=*/*.parquet"):
        path.write_bytes(b"not a parquet file")
    plan.run(spark, records(spark, texts), root, resume=True, **rules)
    index = shards.read_sidecar(spark, root, shards.KEYS)
    assert index.count() == index.select("_key").distinct().count() and index.count() == shards.read_manifest(spark, root).first().total_rows
    plan.run(spark, records(spark, texts), root, resume=True, **rules)  # nothing is new
    assert shards.read_sidecar(spark, root, shards.KEYS).count() == index.count()


def test_resume_after_a_run_that_broke_off(spark):
    """Shards without sidecars, as a run leaves them that ended between the two."""
    root = scratch_dir(spark, "test-broken")
    texts = [f"text number {i} " + "word " * 60 for i in range(12)]
    sink.write_shards(records(spark, texts[:5]), root, ["arrival"], 1000)
    plan.run(spark, records(spark, texts), root, order=["arrival"], script=("A", "z"), shard_chars=1000, resume=True)
    assert sorted(int(r.doc_id) for r in shards.written_records(spark, root).collect()) == list(range(12))
    assert shards.read_manifest(spark, root).first().total_rows == 12


def test_bitmaps_lose_no_key(spark):
    keys = spark.range(0, 3000, 3).select(F.md5(F.col("id").cast("string")).alias("k"))
    rows = spark.range(3000).select("id", F.md5(F.col("id").cast("string")).alias("k"))
    bits = bitmap.bits_for(1000)
    marked = bitmap.maybe_in(rows, "k", bitmap.bitmaps(keys, "k", bits), bits)
    maybe = {r.id for r in marked.filter("_maybe").collect()}
    assert set(range(0, 3000, 3)) <= maybe and len(maybe) < 1400
    assert {r.id for r in bitmap.left_anti(rows, keys, "k", 1000).collect()} == set(range(3000)) - set(range(0, 3000, 3))


def test_fuzzy_run(spark):
    rng = random.Random(9)
    base = ["".join(rng.choices("abcdefghij klmnop", k=2000)) for _ in range(10)]
    root = scratch_dir(spark, "test-fuzzy")
    plan.run(spark, records(spark, base + [t + "z" for t in base]), root, order=["arrival"], fuzzy=True, script=("A", "z"))
    assert {int(r.doc_id) for r in shards.written_records(spark, root).collect()} == set(range(10))


def test_many_small_shards_are_written_by_few_tasks(spark):
    """One file a shard, and no more tasks than the session's cores and the size ask for."""
    root = scratch_dir(spark, "shards")
    rows = spark.range(400).select(F.col("id").alias("arrival"), F.lit(10).cast("bigint").alias("char_count"), F.lit("t").alias("text"))
    made = sink.write_shards(rows, root, ["arrival"], 10)
    listed = shards.list_shards(spark, root).agg(F.count("*").alias("files"), F.count_distinct("shard").alias("shards")).first()
    assert (made["shards"], listed.files, listed.shards) == (400, 400, 400)
    tasks = spark.read.parquet(root).select(F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1)).distinct().count()
    assert tasks <= 2 * spark.sparkContext.defaultParallelism
    assert (sink.write_tasks(spark, 60_000, 100_000), sink.write_tasks(spark, 60, 100_000_000)) == (45, 45)
    assert sink.write_tasks(spark, 1, 10) == 1


def test_merged_files_are_bounded_and_in_order(spark, monkeypatch):
    assert sink.MERGED_FILE_BYTES <= 1 << 26
    root, out = scratch_dir(spark, "shards"), scratch_dir(spark, "merged")
    rows = spark.range(400).select(F.col("id").alias("arrival"), F.lit(10).cast("bigint").alias("char_count"), F.lit("t").alias("text"))
    sink.write_shards(rows, root, ["arrival"], 500)
    monkeypatch.setattr(sink, "MERGED_FILE_BYTES", 2000)
    assert sink.merge_shards(spark, root, out, ["arrival"]) > 1
    got = spark.read.parquet(out).select("arrival", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("r")).orderBy("f", "r").collect()
    assert [g.arrival for g in got] == list(range(400))
