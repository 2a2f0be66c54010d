"""Loads, versions, releases and streams: each writes what Spark derives from the given tables and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamlake.plans import ingest
from loamlake.queries import estate as E
from loamlake.queries.base import Tables, query
from loamlake.queries.corpus import key_sql
from loamlake.runtime import is_folder, scratch_dir
from loamlake.sinks import documents
from loamlake.sinks import tables as K
from loamlake.sinks.folders import append_run, refresh
from loamlake.sources import tables as S
from loamlake.streaming import jobs, stateful

AT, LATER, LATEST = "2024-03-01T08:00:00", "2024-03-02T08:00:00", "2024-03-03T08:00:00"
ORDER_TYPES = {
    "o_orderkey": "bigint",
    "o_custkey": "bigint",
    "o_orderstatus": "text",
    "o_totalprice": "double precision",
    "o_orderdate": "timestamp without time zone",
    "o_orderpriority": "varchar",
}
AUDITED = "TIMESTAMP '2024-03-01 08:00:00' AS _ingested_at, 'erp' AS _source_system, 'sales.orders' AS _source_table"


@query("staged_load", f"SELECT *, {AUDITED}, DATE '2024-03-01' AS _ingest_day FROM orders")
def staged_load(t: Tables):
    """Extract to CSV, read as text, cast, load with audit columns, read the table."""
    folder, target = scratch_dir(t.spark, "stage"), scratch_dir(t.spark, "raw")
    documents.write_csv(t.orders, folder)
    staged = S.read_staged(t.spark, folder, list(ORDER_TYPES))
    ingest.load_staged(staged, ORDER_TYPES, target, source_key="erp", source_table="sales.orders", at=AT)
    return t.spark.read.parquet(target).drop("_run_id")


@query("full_refresh", "SELECT event_id, event_type FROM events WHERE event_type <> 'error'")
def full_refresh(t: Tables):
    """The second load replaces the first."""
    target = scratch_dir(t.spark, "raw")
    rows = t.events.select("event_id", "event_type")
    refresh(rows.filter("event_type = 'error'"), target)
    refresh(rows.filter("event_type <> 'error'"), target)
    return t.spark.read.parquet(target)


@query("incremental_append", "SELECT o_orderkey, o_orderdate, CASE WHEN o_orderdate <= TIMESTAMP '1998-01-01' THEN 1 ELSE 2 END AS load FROM orders")
def incremental_append(t: Tables):
    """First what is up to a mark, then everything newer than the highest value loaded."""
    target = scratch_dir(t.spark, "raw")
    rows = t.orders.select("o_orderkey", "o_orderdate")
    first = rows.filter(F.col("o_orderdate") <= F.lit("1998-01-01").cast("timestamp_ntz"))
    append_run(first.withColumn("load", F.lit(1)), target, "run-1")
    mark = S.next_mark(t.spark.read.parquet(target), "o_orderdate").first().mark
    newer = S.newer_than(rows, "o_orderdate", mark, "timestamp").withColumn("load", F.lit(2))
    for _ in range(2):  # the same run again replaces its own rows
        append_run(newer, target, "run-2")
    return t.spark.read.parquet(target).drop("_run_id")


@query("incremental_batch", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 700")
def incremental_batch(t: Tables):
    return S.newer_than(t.orders, "o_orderkey", "700").select("o_orderkey", "o_custkey")


@query("next_mark", "SELECT CAST(max(event_id) AS VARCHAR) AS mark FROM events")
def next_mark(t: Tables):
    return S.next_mark(t.events, "event_id")


@query(
    "table_versions",
    """SELECT '000000000001' AS version, 'replace' AS operation, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS row_count, 1 AS parts
UNION ALL SELECT '000000000002', 'append', (SELECT count(*) FROM orders WHERE o_orderstatus = 'O'), 2
UNION ALL SELECT '000000000003', 'replace', (SELECT count(*) FROM orders WHERE o_orderstatus IN ('F', 'O')), 1""",
)
def table_versions(t: Tables):
    """Load, append, compact: the log and the rows counted while writing."""
    target = scratch_dir(t.spark, "raw")
    K.write_table(t.orders.filter("o_orderstatus = 'F'"), target, at=AT)
    K.write_table(t.orders.filter("o_orderstatus = 'O'"), target, operation="append", at=LATER)
    K.compact(t.spark, target, 2, at=LATEST)
    return K.log(t.spark, target).select("version", "operation", "row_count", F.size("parts").alias("parts"))


@query(
    "expired_versions",
    "SELECT '000000000001' AS version, count(*) AS row_count FROM orders WHERE o_orderstatus = 'F'",
)
def expired_versions(t: Tables):
    target = scratch_dir(t.spark, "raw")
    for at, status in ((AT, "F"), (LATER, "O"), (LATEST, "P")):
        K.write_table(t.orders.filter(F.col("o_orderstatus") == status), target, at=at)
    return K.expired(t.spark, target, LATER).select("version", "row_count")


@query(
    "pinned_release",
    "SELECT c_custkey, c_name, '000000000001' AS source_version, '000000000001' AS published_version, (SELECT count(*) FROM customer) AS row_count FROM customer",
)
def pinned_release(t: Tables):
    """The release keeps the version it was made from, whatever is loaded later."""
    curated, published = scratch_dir(t.spark, "curated"), scratch_dir(t.spark, "published")
    K.write_table(t.customer.select("c_custkey", "c_name"), curated, at=AT)
    source, version, rows = K.publish(t.spark, curated, published, at=LATER)
    K.write_table(t.customer.limit(0).select("c_custkey", "c_name"), curated, at=LATEST)
    out = K.read_table(t.spark, published)
    return out.select("*", F.lit(source).alias("source_version"), F.lit(version).alias("published_version"), F.lit(rows).cast("bigint").alias("row_count"))


@query("published_view", "SELECT s_suppkey, s_name FROM supplier")
def published_view(t: Tables):
    audited = K.with_audit(t.supplier.select("s_suppkey", "s_name"), AT, source_system="erp", source_table="s", run_id="r")
    K.without_audit(audited).createOrReplaceTempView("v_supplier")
    return t.spark.table("v_supplier")


@query(
    "csv_lines",
    """SELECT CAST(conv_id AS VARCHAR) || ',' || CAST(turn AS VARCHAR) || ',' || role || ',' ||
 CASE WHEN regexp_matches(text, '[",\\r\\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS line FROM conversations""".replace("\\\\", "\\"),
)
def csv_lines(t: Tables):
    return documents.csv_lines(t.conversations.select("conv_id", "turn", "role", "text"))


@query(
    "registry_load",
    """SELECT 'customer' AS table_name, 'succeeded' AS status, (SELECT count(*) FROM customer) AS rows_written, CAST(3 AS BIGINT) AS columns_selected, NULL AS skip_reason, NULL AS mark
UNION ALL SELECT 'orders', 'succeeded', (SELECT count(*) FROM orders WHERE o_orderkey > 100), 2, NULL, (SELECT CAST(max(o_orderkey) AS VARCHAR) FROM orders)
UNION ALL SELECT 'part', 'skipped', NULL, 0, 'none of 1 classified columns is safe', NULL
UNION ALL SELECT 'supplier', 'skipped', NULL, 0, 'table has no classified column', NULL
UNION ALL SELECT 'lineitem', 'skipped', NULL, 1, 'host is not permitted', NULL
UNION ALL SELECT 'nation', 'failed', NULL, 1, NULL, NULL""",
)
def registry_load(t: Tables):
    """All registered tables in one go: loaded, skipped with a reason, or failed without stopping the rest."""
    states = [
        ("customer", "db.example.org", True, True, "full_refresh", None),
        ("orders", "db.example.org", True, True, "incremental", "o_orderkey"),
        ("part", "db.example.org", True, True, "full_refresh", None),
        ("supplier", "db.example.org", True, True, "full_refresh", None),
        ("lineitem", "db.example.net", True, True, "full_refresh", None),
        ("nation", "db.example.org", True, True, "full_refresh", None),
    ]
    listed = t.spark.createDataFrame(
        states, "table_name string, host string, has_registry boolean, source_active boolean, load_mode string, incremental_column string"
    )
    labels = [(n, c, "public", 0) for n, c in [("customer", "c_custkey"), ("customer", "c_nationkey"), ("customer", "c_mktsegment"), ("orders", "o_orderkey"), ("orders", "o_orderdate"), ("lineitem", "l_orderkey"), ("nation", "no_such_column")]]
    labels += [("customer", "c_name", "sensitive", 1), ("part", "p_name", "internal", 1)]
    registry = t.spark.createDataFrame(labels, "table_name string, column_name string, classification string, secret_level int")
    job = ingest.Job(
        root=scratch_dir(t.spark, "lake"),
        source_key="erp",
        read=lambda name, columns: getattr(t, name).select(*columns),
        at=AT,
        denied=["example.net"],
        allowed=["db.example.org"],
        marks={"orders": "100"},
    )
    return ingest.load_all(t.spark, job, listed, registry).select(
        "table_name", "status", "rows_written", "columns_selected", "skip_reason", "mark"
    )


@query(
    "registry_reload",
    """WITH h AS (SELECT max(o_orderkey) AS top, max(o_orderkey) // 2 AS half FROM orders)
SELECT 1 AS run, 'orders' AS table_name, 'succeeded' AS status, (SELECT count(*) FROM orders, h WHERE o_orderkey <= half) AS rows_written, (SELECT CAST(max(o_orderkey) AS VARCHAR) FROM orders, h WHERE o_orderkey <= half) AS mark
UNION ALL SELECT 3, 'orders', 'skipped', NULL, NULL
UNION ALL SELECT 4, 'orders', 'succeeded', (SELECT count(*) FROM orders, h WHERE o_orderkey > half), (SELECT CAST(top AS VARCHAR) FROM h)
UNION ALL SELECT 5, 'orders', 'succeeded', 0, (SELECT CAST(top AS VARCHAR) FROM h)
UNION ALL SELECT 6, 'orders', 'abandoned', 1, (SELECT CAST(max(o_orderkey) AS VARCHAR) FROM orders, h WHERE o_orderkey <= half)
UNION ALL SELECT 7, 'orders', 'in target', count(*), NULL FROM orders""",
)
def registry_reload(t: Tables):
    """Runs that know each other by the run log and their claims alone.

    The first loads half the table, the second is killed, the third comes too early, the fourth comes after the
    claim's age, closes the second and loads the rest, the fifth finds nothing.
    """
    listed = t.spark.createDataFrame(
        [("orders", "db.example.org", True, True, "incremental", "o_orderkey")],
        "table_name string, host string, has_registry boolean, source_active boolean, load_mode string, incremental_column string",
    )
    registry = t.spark.createDataFrame([("orders", "o_orderkey", "public", 0), ("orders", "o_custkey", "public", 0)], "table_name string, column_name string, classification string, secret_level int")
    half = t.orders.agg(F.floor(F.max("o_orderkey") / 2).alias("half"))
    root, log = scratch_dir(t.spark, "lake"), scratch_dir(t.spark, "runs")

    class Killed(BaseException):
        pass

    def killed(name, columns):
        raise Killed

    out = None
    for run, hour in ((1, 0), (2, 1), (3, 2), (4, 8), (5, 9)):
        there = t.orders.filter(F.col("o_orderkey") <= half.scalar()) if run == 1 else t.orders
        read = killed if run == 2 else lambda name, columns, df=there: df.select(*columns)
        job = ingest.Job(root=root, source_key="erp", read=read, at=AT, allowed=["db.example.org"], log=log, now=lambda hour=hour: 3600.0 * hour)
        try:
            made = ingest.load_all(t.spark, job, listed, registry).select(F.lit(run).alias("run"), "table_name", "status", "rows_written", "mark")
        except Killed:
            continue
        out = made if out is None else out.unionByName(made)
    log_rows = t.spark.read.parquet(log)
    closed = log_rows.filter("status = 'failed' AND error_message LIKE 'abandoned%'").groupBy("mark").agg(F.count("*").alias("rows_written"))
    loaded = t.spark.read.parquet(f"{root}/raw/orders").agg(F.count("*").alias("rows_written")).withColumn("mark", F.lit(None).cast("string"))
    label = lambda df, run, status: df.select(F.lit(run).alias("run"), F.lit("orders").alias("table_name"), F.lit(status).alias("status"), "rows_written", "mark")
    return out.unionByName(label(closed, 6, "abandoned")).unionByName(label(loaded, 7, "in target"))


@query("changed_only", "SELECT n_nationkey, n_name, CAST(2 AS BIGINT) AS versions FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def changed_only(t: Tables):
    """Three publications, the second of which changes nothing."""
    target = scratch_dir(t.spark, "published")
    all_rows = t.nation.select("n_nationkey", "n_name").join(
        t.customer.select(F.col("c_nationkey").alias("n_nationkey")), "n_nationkey", "left_semi"
    )
    few = all_rows.filter("n_nationkey > 3")
    for rows, at in ((few, AT), (few.orderBy(F.desc("n_name")), LATER), (all_rows, LATEST)):
        jobs.publish_if_changed(rows, target, at=at)
    versions = K.log(t.spark, target).agg(F.count("*")).scalar()
    return K.read_table(t.spark, target).withColumn("versions", versions)


# -- streams ----------------------------------------------------------------


def stream(t: Tables, name: str):
    schema = getattr(t, name).schema
    reader, path = t.spark.readStream.schema(schema), f"{t.folder}/{name}.parquet"
    # A stream reads folders: the table's own, or the one its single file lies in.
    return reader.parquet(path) if is_folder(t.spark, path) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(t.folder)


@query("stream_append", "SELECT event_id, event_type FROM events")
def stream_append(t: Tables):
    """Incremental load by file offsets; the second run finds nothing new."""
    out, checkpoint = scratch_dir(t.spark, "out"), scratch_dir(t.spark, "checkpoint")
    for _ in range(2):
        jobs.append_new_files(stream(t, "events").select("event_id", "event_type"), out, checkpoint).awaitTermination()
    return t.spark.read.parquet(out)


@query("stream_dedup", f"SELECT min(doc_id) AS doc_id, {key_sql('text')} AS text_key FROM documents GROUP BY 2")
def stream_dedup(t: Tables):
    """Documents arrive out of order, a file a batch; the earliest of all copies is kept."""
    folder, out, checkpoint = (scratch_dir(t.spark, n) for n in ("documents", "out", "checkpoint"))
    ts = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id"))
    timed = t.documents.select("doc_id", "text", ts.alias("ts"))
    timed.repartition(4, F.xxhash64("doc_id")).write.parquet(folder)
    # A record far ahead moves the watermark past all others.
    last = t.spark.range(1).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.to_timestamp(F.lit("2099-01-01")).alias("ts"))
    last.coalesce(1).write.mode("append").parquet(folder)
    arriving = t.spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    kept = stateful.first_copies(arriving, late="400 days")
    jobs.append_new_files(kept, out, checkpoint).awaitTermination()
    return t.spark.read.parquet(out).select(F.col("place").alias("doc_id"), F.col("key").alias("text_key"))


@query(
    "file_watch",
    "SELECT conv_id, turn, role, md5(text) AS text_md5, 'extract_conversations' AS _source_table FROM conversations",
)
def file_watch(t: Tables):
    """Declared extracts dropped into a folder are loaded, typed and stamped, of two the later one; others are left alone."""
    folder, root, checkpoint = (scratch_dir(t.spark, n) for n in ("incoming", "raw", "checkpoint"))
    name = "extract_conversations"
    rows = t.conversations.select("conv_id", "turn", "role", "text")
    documents.write_csv(rows.filter("turn = 0").coalesce(1), f"{folder}/{name}.csv")
    documents.write_csv(rows.coalesce(1), f"{folder}/{name}-2.csv")
    documents.write_csv(t.nation, f"{folder}/unrelated.csv")
    declared = {name: {"conv_id": "bigint", "turn": "bigint", "role": "string", "text": "string"}}
    for started in jobs.watch_extracts(t.spark, folder, declared, root, checkpoint, AT):
        started.awaitTermination()
    loaded = K.read_table(t.spark, f"{root}/{name}")
    return loaded.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"), "_source_table")


@query("stream_publish", "SELECT lower(n_name) AS group_name, count(*) AS members FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def stream_publish(t: Tables):
    """Every change of the grants derives the member counts afresh and publishes them if they differ."""
    target, checkpoint = scratch_dir(t.spark, "published"), scratch_dir(t.spark, "checkpoint")
    systems = t.sql(E.SYSTEMS)

    def derive(batch):
        grants = batch.sparkSession.read.parquet(f"{t.folder}/customer.parquet")
        joined = grants.join(systems, F.col("c_nationkey") == F.col("source_system_id"))
        return joined.groupBy(F.col("source_key").alias("group_name")).agg(F.count("*").alias("members"))

    jobs.publish_changes(stream(t, "customer"), derive, target, checkpoint).awaitTermination()
    return K.read_table(t.spark, target)


@query(
    "failure_limiter",
    """WITH RECURSIVE e AS (SELECT CASE WHEN user_id % 3 = 0 THEN 'shared' ELSE CAST(user_id AS VARCHAR) END AS k, event_id, ts, event_type = 'error' AS failed FROM events WHERE event_type IN ('error', 'purchase')),
a AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts, event_id) AS n FROM e),
w AS (SELECT k, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, false AS failed, true AS allowed, CAST(0 AS BIGINT) AS retry_after, 0 AS cnt, CAST(NULL AS TIMESTAMP) AS opened FROM (SELECT DISTINCT k FROM a)
 UNION ALL SELECT k, n, event_id, failed, c < 3, CASE WHEN c >= 3 THEN greatest(1, CAST(ceil(date_diff('microsecond', ts, o + INTERVAL 240 HOUR) / 1000000.0) AS BIGINT)) ELSE 0 END,
  CASE WHEN c >= 3 THEN c WHEN NOT failed THEN 0 ELSE c + 1 END, CASE WHEN c >= 3 THEN o WHEN NOT failed THEN NULL WHEN o IS NULL THEN ts ELSE o END
  FROM (SELECT a.*, CASE WHEN w.opened IS NOT NULL AND a.ts > w.opened + INTERVAL 240 HOUR THEN 0 ELSE w.cnt END AS c,
   CASE WHEN w.opened IS NOT NULL AND a.ts > w.opened + INTERVAL 240 HOUR THEN NULL ELSE w.opened END AS o FROM w JOIN a ON a.k = w.k AND a.n = w.n + 1))
SELECT k AS "key", event_id, failed, allowed, retry_after FROM w WHERE n > 0""",
)
def failure_limiter(t: Tables):
    """Errors are failed attempts, purchases successful ones; three failures close a key for ten days.

    A third of all attempts has one key; they arrive in six batches, one after another in time.
    """
    folder, out, checkpoint = (scratch_dir(t.spark, n) for n in ("attempts", "out", "checkpoint"))
    key = F.when(F.col("user_id") % 3 == 0, F.lit("shared")).otherwise(F.col("user_id").cast("string"))
    attempts = t.events.filter("event_type IN ('error', 'purchase')").select(
        key.alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("failed")
    )
    for part in range(6):
        days = F.least(F.floor((F.dayofmonth("ts") - 1) / 6), F.lit(5))
        attempts.filter(days == part).write.mode("append").parquet(f"{folder}/part={part}")
    schema = "key string, event_id bigint, ts timestamp, failed boolean"
    for part in range(6):  # a run a part: the next begins where the last left its state
        arriving = t.spark.readStream.schema(schema).parquet(f"{folder}/part=[0-{part}]")
        limited = stateful.limit_failures(arriving, max_failures=3, window_seconds=240 * 3600)
        jobs.append_new_files(limited, out, checkpoint).awaitTermination()
    return t.spark.read.parquet(out).select("key", "event_id", "failed", "allowed", "retry_after")
