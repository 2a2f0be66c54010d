from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from loamlake.functions.types import spark_type, split_castable, typed
from loamlake.plans import ingest
from loamlake.runtime import path_exists, scratch_dir
from loamlake.sinks import documents, folders
from loamlake.sinks import tables as K
from loamlake.streaming import jobs

DAY = [f"2024-03-0{d}T00:00:00" for d in range(1, 8)]


def rows(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "n int")


def ns(df):
    return sorted(r.n for r in df.collect())


def test_versions_append_replace_expire(spark):
    table = scratch_dir(spark, "table")
    assert K.latest_version(spark, table) is None
    v1, n1 = K.write_table(rows(spark, 1, 2), table, at=DAY[0])
    v2, n2 = K.write_table(rows(spark, 3), table, operation="append", at=DAY[1])
    assert (n1, n2) == (2, 1) and ns(K.read_table(spark, table)) == [1, 2, 3] and ns(K.read_table(spark, table, v1)) == [1, 2]
    v3 = K.compact(spark, table, 1, at=DAY[2])
    assert ns(K.read_table(spark, table)) == [1, 2, 3] and v3 == "000000000003"
    assert K.orphan_files(spark, table, K.log(spark, table)).count() == 0
    assert K.expire(spark, table, DAY[2]) == [f"v={v1}", f"v={v2}"]
    K.expire(spark, table, DAY[2], dry_run=False)
    assert ns(K.read_table(spark, table)) == [1, 2, 3]
    rows(spark, 9).write.parquet(f"{table}/v=000000000099")
    live = K.log(spark, table)
    assert K.orphan_files(spark, table, live).count() > 0


def test_empty_load_counts_zero(spark):
    assert K.write_table(rows(spark, 1).limit(0), scratch_dir(spark, "table"), at=DAY[0])[1] == 0


def test_publish_is_pinned(spark):
    curated, published = scratch_dir(spark, "curated"), scratch_dir(spark, "published")
    with pytest.raises(ValueError, match="source_has_no_snapshot"):
        K.publish(spark, curated, published)
    df = spark.createDataFrame([("eng", 10), ("eng", 20), ("med", 30)], "org_unit string, amount int")
    K.write_table(df, curated, at=DAY[0])
    source, version, count = K.publish(spark, curated, published, at=DAY[1])
    assert (source, version, count) == ("000000000001", "000000000001", 3)
    K.write_table(df.limit(1), curated, at=DAY[2])
    K.publish(spark, curated, published, at=DAY[3])
    assert K.read_table(spark, published).count() == 1 and K.read_table(spark, published, version).count() == 3


def test_typed_cast_is_strict(spark):
    staged = spark.createDataFrame([("1", ""), ("x", "2024-01-01")], "a string, b string")
    assert typed(staged.filter("a = '1'"), {"a": "int", "b": "date"}).first().asDict() == {"a": 1, "b": None}
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        typed(staged, {"a": "int"}).collect()
    good, bad = split_castable(staged, {"a": "int", "b": "date"})
    assert good.count() == 1 and bad.first()._failing == ["a"]


@pytest.mark.parametrize(
    ("source", "target"),
    [("INT2", "smallint"), ("numeric(12,2)", "decimal(38,9)"), ("timestamp with time zone", "timestamp"), ("timestamp without time zone", "timestamp_ntz"), ("uuid", "string"), (None, "string")],
)
def test_type_map(source, target):
    assert spark_type(source) == target


def test_the_registry_decides_what_is_loaded(spark):
    """Safe columns only, skips with reasons, one mark."""
    source = {
        "shop.items": spark.range(40).selectExpr("id AS item_id", "id % 3 AS kind", "concat('p', id) AS private_note", "current_timestamp() AS changed"),
        "shop.sales": spark.range(1, 301).selectExpr("id AS sale_id", "id % 40 AS item_id", "id * 2 AS price"),
        "shop.secrets": spark.range(5).selectExpr("id AS person", "'x' AS diagnosis"),
        "shop.closed": spark.range(5).selectExpr("id AS code"),
    }
    labels = {"private_note": ("sensitive", 2), "price": ("sensitive", 2), "person": ("sensitive", 2), "diagnosis": ("sensitive", 2), "changed": ("internal", 1)}
    rows_ = [(name, c, *labels.get(c, ("public", 0))) for name, df in source.items() for c in df.columns]
    registry = spark.createDataFrame(rows_, "table_name string, column_name string, classification string, secret_level int")
    listed = spark.createDataFrame(
        [(n, "db.sim", True, n != "shop.closed", "incremental" if n == "shop.sales" else "full_refresh", "sale_id" if n == "shop.sales" else None) for n in [*source, "shop.scratch"]],
        "table_name string, host string, has_registry boolean, source_active boolean, load_mode string, incremental_column string",
    )
    job = ingest.Job(root=scratch_dir(spark, "lake"), source_key="sim", read=lambda n, c: source[n].select(*c), at=DAY[0], denied=["example.net"], allowed=["db.sim"])
    runs = {r.table_name: r for r in ingest.load_all(spark, job, listed, registry).collect()}
    assert {n for n, r in runs.items() if r.status == "skipped"} == {"shop.secrets", "shop.closed", "shop.scratch"}
    assert all(r.skip_reason for r in runs.values() if r.status == "skipped")
    assert (runs["shop.items"].columns_selected, runs["shop.items"].rows_written) == (2, 40) and runs["shop.sales"].mark == "300"
    items = spark.read.parquet(f"{job.root}/raw/items")
    assert set(K.without_audit(items).columns) == {"item_id", "kind"} and set(K.AUDIT) <= set(items.columns)
    again = ingest.Job(**{**job.__dict__, "at": DAY[1], "marks": {"shop.sales": "300"}})
    second = {r.table_name: r for r in ingest.load_all(spark, again, listed, registry).collect()}
    assert (second["shop.sales"].rows_written, second["shop.sales"].mark) == (0, "300")
    assert spark.read.parquet(f"{job.root}/raw/sales").count() == 300


def test_bad_value_fails_the_load(spark):
    staged = spark.createDataFrame([("x",)], "a string")
    target = scratch_dir(spark, "raw")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        ingest.load_staged(staged, {"a": "integer"}, target, source_key="s", source_table="t", at=DAY[0])
    assert not path_exists(spark, target)
    assert ingest.load_routed(staged, {"a": "int"}, target, scratch_dir(spark, "rejected")) == (0, 1)


class Killed(BaseException):
    pass


def orders_job(spark, log, root, df, hour, **more):
    listed = spark.createDataFrame([("o", "h", True, True, "incremental", "k")], "table_name string, host string, has_registry boolean, source_active boolean, load_mode string, incremental_column string")
    registry = spark.createDataFrame([("o", "k", "public", 0)], "table_name string, column_name string, classification string, secret_level int")
    job = ingest.Job(root=root, source_key="s", read=lambda n, c: df.select(*c), at=DAY[0], allowed=["h"], log=log, now=lambda: 3600.0 * hour, **more)
    return ingest.load_all(spark, job, listed, registry).first()


def test_a_run_killed_after_its_write_is_not_loaded_twice(spark, monkeypatch):
    log, root = scratch_dir(spark, "runs"), scratch_dir(spark, "lake")
    df = spark.range(10).withColumnRenamed("id", "k")
    noted = ingest.note

    def killed(spark, job, row):
        if row[2] == "succeeded":
            raise Killed
        noted(spark, job, row)

    monkeypatch.setattr(ingest, "note", killed)
    with pytest.raises(Killed):
        orders_job(spark, log, root, df, 0)
    monkeypatch.setattr(ingest, "note", noted)
    assert orders_job(spark, log, root, df, 5).status == "skipped"
    after = orders_job(spark, log, root, spark.range(12).withColumnRenamed("id", "k"), 7)
    assert (after.status, after.rows_written, after.mark) == ("succeeded", 2, "11")
    assert sorted(r.k for r in spark.read.parquet(f"{root}/raw/o").collect()) == list(range(12))


def test_of_two_claims_one_wins(spark):
    folder = scratch_dir(spark, "claims")
    with ThreadPoolExecutor(8) as pool:
        put = list(pool.map(lambda i: folders.put_if_absent(spark, f"{folder}/t", f"run-{i}"), range(8)))
    assert put.count(True) == 1 and folders.read_small(spark, f"{folder}/t") == f"run-{put.index(True)}"
    moved = [folders.rename(spark, f"{folder}/t", f"{folder}/t.old") for _ in range(2)]
    assert moved == [True, False]


def test_a_broken_swap_leaves_the_old_contents(spark, monkeypatch):
    target = scratch_dir(spark, "swap")
    folders.refresh(rows(spark, 1), target)
    renamed = folders.rename
    monkeypatch.setattr(folders, "rename", lambda s, old, new: False if new == target and "/." in old else renamed(s, old, new))
    with pytest.raises(OSError):
        folders.refresh(rows(spark, 2), target)
    assert ns(spark.read.parquet(target)) == [1]
    monkeypatch.setattr(folders, "rename", renamed)
    folders.rename(spark, target, target + folders.ASIDE)  # as a crash between the two moves leaves it
    folders.settle(spark, target)
    assert ns(spark.read.parquet(target)) == [1] and folders.refresh(rows(spark, 3, 4), target) == 2


def test_catalogue_is_refused_with_forbidden_word(spark):
    folder = scratch_dir(spark, "catalogue")
    stats, domains = rows(spark, 1), rows(spark, 2)
    good = spark.createDataFrame([("t", None)], "title string, note string")
    documents.write_catalogue(stats, domains, good, folder, ["password"])
    assert sorted(r.value for r in spark.read.text(folder).collect()) == ['{"dataset":{"title":"t","note":null}}', '{"domain":{"n":2}}', '{"stats":{"n":1}}']
    with pytest.raises(ValueError, match="refusing to publish"):
        documents.write_catalogue(stats, domains, good.withColumn("title", F.lit("PassWord")), folder, ["password"])
    assert spark.read.text(folder).count() == 3
    documents.write_catalogue(stats, domains, good.limit(0), folder, ["password"])
    assert spark.read.text(folder).count() == 2


def test_a_failure_after_the_check_leaves_the_old_catalogue(spark, monkeypatch):
    folder = scratch_dir(spark, "catalogue")
    one, other = spark.createDataFrame([("old",)], "title string"), spark.createDataFrame([("new",)], "title string")
    documents.write_catalogue(rows(spark, 1), rows(spark, 2), one, folder, [])

    def fails(*_):
        raise OSError("no space")

    monkeypatch.setattr(documents, "swap_in", fails)
    with pytest.raises(OSError):
        documents.write_catalogue(rows(spark, 1), rows(spark, 2), other, folder, [])
    assert spark.read.text(folder).filter("value LIKE '%old%'").count() == 1


def test_publish_if_changed(spark):
    table = scratch_dir(spark, "groups")
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "g string, n int")
    assert jobs.publish_if_changed(df, table, DAY[0])
    assert not jobs.publish_if_changed(df.repartition(3).orderBy(F.desc("g")), table, DAY[1])
    assert jobs.publish_if_changed(df.distinct(), table, DAY[2])
