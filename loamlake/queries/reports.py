"""Report queries over events, orders, customer, conversations and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamlake.functions import formats as M
from loamlake.operators import registry as G
from loamlake.operators import reports as R
from loamlake.queries.base import TABLES, Tables, query
from loamlake.sources import files

BKK = "(ts + INTERVAL 7 HOUR)"
ORDERED = "(o_orderdate + INTERVAL 7 HOUR)"


@query(
    "activity_by_hour",
    f"SELECT CAST(hour({BKK}) AS INTEGER) AS hour_local, count(*) AS conversations, count(DISTINCT user_id) AS unique_users FROM events GROUP BY 1",
)
def activity_by_hour(t: Tables):
    return R.by_hour(t.events, "ts", "user_id")


@query(
    "activity_by_month",
    f"""SELECT strftime({ORDERED}, '%Y-%m') AS month, count(*) AS conversations, count(DISTINCT o_custkey) AS unique_users,
    CAST(coalesce(sum(1 + o_orderkey % 5), 0) AS BIGINT) AS messages FROM orders GROUP BY 1""",
)
def activity_by_month(t: Tables):
    return R.by_month(t.orders.withColumn("messages", F.col("o_orderkey") % 5 + 1), "o_orderdate", "o_custkey", "messages")


@query(
    "activity_by_weekday",
    f"""SELECT CAST(isodow({BKK}) - 1 AS INTEGER) AS dow_num,
    ['จันทร์', 'อังคาร', 'พุธ', 'พฤหัสบดี', 'ศุกร์', 'เสาร์', 'อาทิตย์'][isodow({BKK})] AS dow_label, count(*) AS conversations
    FROM events GROUP BY 1, 2""",
)
def activity_by_weekday(t: Tables):
    return R.by_weekday(t.events, "ts")


@query(
    "by_type_and_prop",
    "SELECT event_type AS endpoint, props ->> '$.k' AS spec, count(*) AS conversations FROM events GROUP BY 1, 2",
)
def by_type_and_prop(t: Tables):
    return R.activity(t.events, {"endpoint": F.col("event_type"), "spec": F.get_json_object("props", "$.k")})


@query(
    "users_by_group",
    r"""SELECT lower(regexp_extract(address, '@([^@\s]+)\s*$', 1)) AS user_group, count(*) AS conversations, count(DISTINCT c_custkey) AS unique_users
FROM (SELECT c_custkey, o_orderkey, 'c' || CAST(c_custkey AS VARCHAR) || '@' || CASE WHEN c_custkey % 400 = 7 THEN 'Tiny.example' ELSE c_mktsegment || '.Example' END AS address
      FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 1 HAVING count(DISTINCT c_custkey) >= 10""",
)
def users_by_group(t: Tables):
    domain = F.when(F.col("c_custkey") % 400 == 7, "Tiny.example").otherwise(F.concat("c_mktsegment", F.lit(".Example")))
    address = F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@"), domain)
    users = t.customer.select("c_custkey", R.email_domain(address).alias("user_group"))
    orders = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    return R.by_user_group(orders, "c_custkey", {}, users, ["user_group"])


@query(
    "group_month_k",
    f"""SELECT strftime({ORDERED}, '%Y-%m') AS month, c_nationkey AS user_group, count(*) AS conversations, count(DISTINCT o_custkey) AS unique_users
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2 HAVING count(DISTINCT o_custkey) >= 10""",
)
def group_month_k(t: Tables):
    users = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("user_group"))
    period = {"month": M.month(M.local_time(F.col("o_orderdate")))}
    return R.by_user_group(t.orders, "o_custkey", period, users, ["user_group"])


@query(
    "user_cohorts",
    """SELECT strftime(f + INTERVAL 7 HOUR, '%Y-%m') AS signup_month, count(*) AS new_users
FROM (SELECT o_custkey, min(o_orderdate) AS f FROM orders GROUP BY 1) GROUP BY 1""",
)
def user_cohorts(t: Tables):
    return R.cohorts(t.orders, "o_orderdate", "o_custkey")


@query(
    "user_mix",
    """SELECT 'type' AS dimension, event_type AS "value", count(DISTINCT user_id) AS users FROM events GROUP BY 2
UNION ALL SELECT 'big', CASE WHEN "value" > 50 THEN 'true' ELSE 'false' END, count(DISTINCT user_id) FROM events GROUP BY 2""",
)
def user_mix(t: Tables):
    return R.mix(t.events, {"type": F.col("event_type"), "big": F.col("value") > 50}, "user_id")


@query("collection_profile")
def _registered_profile(t: Tables):
    return collection_profile(t)


def collection_profile(t: Tables):
    # A table is a file or a folder of files; their bytes are summed by the table's name in the path.
    table = F.regexp_extract("path", r"/(\w+)\.parquet(?:/[^/]*)?\z", 1)
    sizes = files.list_files(t.spark, t.folder).groupBy(table.alias("collection")).agg(F.sum("bytes").alias("bytes"))
    return R.collection_profile({n: getattr(t, n) for n in TABLES}, sizes)


@query("collection_counts", " UNION ALL ".join(f"SELECT '{n}' AS collection, count(*) AS doc_count, true AS is_stored FROM {n}" for n in TABLES))
def collection_counts(t: Tables):
    """The profile's counts, and whether a collection takes room at all; its bytes are checked by a test."""
    return collection_profile(t).select("collection", "doc_count", (F.col("data_mb") > 0).alias("is_stored"))


@query("row_counts", "SELECT count(*) AS row_count FROM lineitem")
def row_counts(t: Tables):
    return t.lineitem.agg(F.count("*").alias("row_count"))


@query(
    "filtered_counts",
    "SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, count(*) FILTER (WHERE o_totalprice > 200000) AS large FROM orders",
)
def filtered_counts(t: Tables):
    return t.orders.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("o_orderstatus") == "F").alias("finished"),
        F.count_if(F.col("o_totalprice") > 200000).alias("large"),
    )


@query("distinct_owners", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS owners FROM orders GROUP BY 1")
def distinct_owners(t: Tables):
    return t.orders.groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("owners"))


@query(
    "sum_or_zero",
    "SELECT c_custkey, CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
)
def sum_or_zero(t: Tables):
    totals = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("s"))
    return t.customer.join(totals, "c_custkey", "left").select("c_custkey", F.coalesce("s", F.lit(0)).cast("double").alias("total"))


@query(
    "last_seen",
    "SELECT event_type AS table_name, max(ts) AS last_ingested_at, max(event_id) AS last_run_id FROM events GROUP BY 1",
)
def last_seen(t: Tables):
    return t.events.groupBy(F.col("event_type").alias("table_name")).agg(
        F.max("ts").alias("last_ingested_at"), F.max("event_id").alias("last_run_id")
    )


@query(
    "tables_without_public",
    """SELECT o_custkey, count(*) AS columns, count(*) FILTER (WHERE o_orderpriority LIKE '5%') AS public
FROM orders GROUP BY 1 HAVING count(*) FILTER (WHERE o_orderpriority LIKE '5%') = 0""",
)
def tables_without_public(t: Tables):
    measures = {"columns": F.count("*"), "public": F.count_if(F.startswith("o_orderpriority", F.lit("5")))}
    return R.having(t.orders, ["o_custkey"], measures, F.col("public") == 0)


@query("big_number", "SELECT CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem")
def big_number(t: Tables):
    return R.chart(t.lineitem, metrics={"quantity": F.sum(F.col("l_quantity").cast("bigint"))})


@query(
    "pie_chart",
    """SELECT event_type, CAST(sum(CAST("value" AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100""",
)
def pie_chart(t: Tables):
    amount = F.sum(F.col("value").cast("decimal(18,2)")).cast("double")
    return R.chart(t.events, columns=["event_type"], metrics={"amount": amount}, order=[F.desc("amount"), F.asc("event_type")], row_limit=100)


@query(
    "bar_chart",
    "SELECT l_returnflag, l_linestatus, count(*) AS lines, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 1000",
)
def bar_chart(t: Tables):
    metrics = {"lines": F.count("*"), "quantity": F.sum(F.col("l_quantity").cast("bigint"))}
    return R.chart(t.lineitem, columns=["l_returnflag", "l_linestatus"], metrics=metrics, order=[F.asc("l_returnflag"), F.asc("l_linestatus")], row_limit=1000)


@query(
    "raw_table_chart",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 500",
)
def raw_table_chart(t: Tables):
    return R.chart(t.orders, columns=["o_orderkey", "o_custkey", "o_totalprice"], order=[F.desc("o_totalprice"), F.asc("o_orderkey")], row_limit=500)


@query(
    "open_first_list",
    """SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders
ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey LIMIT 200""",
)
def open_first_list(t: Tables):
    rank = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    return R.chart(t.orders, columns=["o_orderkey", "o_orderstatus", "o_orderdate"], order=[rank, F.desc("o_orderdate"), F.asc("o_orderkey")], row_limit=200)


@query(
    "account_list",
    """SELECT c_custkey, c_name FROM customer
ORDER BY c_acctbal >= 0 DESC, lower(coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, c_name)), c_custkey LIMIT 1000""",
)
def account_list(t: Tables):
    display = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment"))
    ordered = t.customer.orderBy(F.desc(F.col("c_acctbal") >= 0), F.lower(F.coalesce(display, "c_name")), "c_custkey")
    return ordered.select("c_custkey", "c_name").limit(1000)


@query(
    "capped_result",
    "SELECT r_name, count(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1",
)
def capped_result(t: Tables):
    placed = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    joined = t.customer.join(placed, F.col("c_nationkey") == F.col("n_nationkey"))
    return G.capped(joined.groupBy("r_name").agg(F.count("*").alias("nations")), 10_000)


@query(
    "reconciled_totals",
    """WITH a AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1), e AS (SELECT o_orderkey AS k, 4 AS n FROM orders)
SELECT coalesce(a.k, e.k) AS order_key, coalesce(a.n, 0) AS actual, CAST(coalesce(e.n, 0) AS BIGINT) AS expected,
       CAST(coalesce(a.n, 0) - coalesce(e.n, 0) AS BIGINT) AS difference FROM a FULL OUTER JOIN e ON a.k = e.k""",
)
def reconciled_totals(t: Tables):
    actual = t.lineitem.groupBy(F.col("l_orderkey").alias("order_key")).agg(F.count("*").alias("n"))
    expected = t.orders.select(F.col("o_orderkey").alias("order_key"), F.lit(4).cast("bigint").alias("n"))
    return G.reconcile(actual, expected, "order_key", "n")


@query(
    "ordered_json",
    """SELECT n_regionkey, '[' || string_agg('{"key":' || CAST(n_nationkey AS VARCHAR) || ',"name":"' || n_name || '"}', ',' ORDER BY n_name, n_nationkey) || ']' AS nations
FROM nation GROUP BY 1""",
)
def ordered_json(t: Tables):
    # Nations per region are few whatever the data's size.
    listed = F.array_sort(F.collect_list(F.struct(F.col("n_name").alias("o"), F.col("n_nationkey").alias("key"))))
    items = F.transform(listed, lambda s: F.struct(s["key"].alias("key"), s["o"].alias("name")))
    return t.nation.groupBy("n_regionkey").agg(F.to_json(items).alias("nations"))


@query(
    "ordered_names",
    "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1",
)
def ordered_names(t: Tables):
    return t.nation.groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("names"))


@query(
    "human_ages",
    """WITH m AS (SELECT event_id, CAST(floor(date_diff('microsecond', ts, TIMESTAMP '2024-01-30 23:00:00') / 60000000.0 + 0.5) AS BIGINT) AS mins FROM events),
h AS (SELECT *, CAST(floor(mins / 60.0 + 0.5) AS BIGINT) AS hrs FROM m)
SELECT event_id, CASE WHEN mins < 60 THEN 'minutes' WHEN hrs < 24 THEN 'hours' ELSE 'days' END AS age_unit,
       CASE WHEN mins < 60 THEN greatest(mins, 0) WHEN hrs < 24 THEN hrs ELSE CAST(floor(hrs / 24.0 + 0.5) AS BIGINT) END AS age_count FROM h""",
)
def human_ages(t: Tables):
    unit, count = M.age_parts(F.col("ts"), F.lit("2024-01-30 23:00:00").cast("timestamp_ntz"))
    return t.events.select("event_id", unit.alias("age_unit"), count.alias("age_count"))


@query(
    "human_sizes",
    """WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(l_extendedprice * l_extendedprice / 4) AS BIGINT) AS size FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, size,
 CASE WHEN size >= 1073741824 THEN CASE WHEN size / 1073741824.0 >= 10 THEN CAST(CAST(round(size / 1073741824.0, 0) AS BIGINT) AS VARCHAR) ELSE CAST(CAST(round(size / 1073741824.0, 1) AS DECIMAL(20,1)) AS VARCHAR) END || ' GB'
      WHEN size >= 1048576 THEN CASE WHEN size / 1048576.0 >= 10 THEN CAST(CAST(round(size / 1048576.0, 0) AS BIGINT) AS VARCHAR) ELSE CAST(CAST(round(size / 1048576.0, 1) AS DECIMAL(20,1)) AS VARCHAR) END || ' MB'
      WHEN size >= 1024 THEN CASE WHEN size / 1024.0 >= 10 THEN CAST(CAST(round(size / 1024.0, 0) AS BIGINT) AS VARCHAR) ELSE CAST(CAST(round(size / 1024.0, 1) AS DECIMAL(20,1)) AS VARCHAR) END || ' KB'
      WHEN size > 0 THEN CAST(size AS VARCHAR) || ' B' ELSE '0 B' END AS label FROM b""",
)
def human_sizes(t: Tables):
    size = F.floor(F.col("l_extendedprice") * F.col("l_extendedprice") / 4).cast("bigint").alias("size")
    sized = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", size)
    return sized.withColumn("label", M.human_bytes(F.col("size")))


@query(
    "iso_and_local",
    r"""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at_utc, ts + INTERVAL 7 HOUR AS at_local,
    CAST(round(date_diff('microsecond', ts, TIMESTAMP '2024-02-01 00:00:00') / 3600000000.0, 1) AS DOUBLE) AS age_hours,
    sha256(CAST(user_id AS VARCHAR)) AS who FROM events""",
)
def iso_and_local(t: Tables):
    ts = F.col("ts")
    age = M.age_hours(ts, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")).cast("double")
    return t.events.select(
        "event_id",
        M.iso_utc(ts).alias("at_utc"),
        M.local_time(ts).alias("at_local"),
        age.alias("age_hours"),
        M.pseudonym(F.col("user_id")).alias("who"),
    )


@query(
    "weekday_groups",
    f"""SELECT event_type AS user_group, CAST(isodow({BKK}) - 1 AS INTEGER) AS dow_num, count(*) AS conversations, count(DISTINCT user_id) AS unique_users
FROM events GROUP BY 1, 2 HAVING count(DISTINCT user_id) >= 10""",
)
def weekday_groups(t: Tables):
    return R.by_group(t.events, {"user_group": F.col("event_type"), "dow_num": F.weekday(M.local_time(F.col("ts")))}, "user_id")
