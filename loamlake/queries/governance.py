"""Registry, safety, search, check and access queries over tables derived from the given ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamlake.functions import formats as M
from loamlake.functions import names as N
from loamlake.functions import types as Y
from loamlake.operators import guard, lifecycle, policy, profile, rules, search
from loamlake.operators import registry as G
from loamlake.queries import estate as E
from loamlake.queries.base import Tables, query
from loamlake.runtime import scratch_dir
from loamlake.sinks import documents
from loamlake.sources import tables as S

LAST = "(SELECT max(o_orderdate) FROM orders)"


def last_order(t: Tables):
    return t.orders.agg(F.max("o_orderdate")).scalar()


def ctes(**named: str) -> str:
    return "WITH " + ", ".join(f"{name} AS ({sql})" for name, sql in named.items()) + "\n"


# -- safe columns -----------------------------------------------------------

REGISTRY = """
SELECT 'customer' AS table_name, column_name, classification, secret_level FROM
(SELECT * FROM (VALUES ('c_custkey', 'public', 0), ('c_name', 'sensitive', 1), ('c_nationkey', 'public', 0),
 ('c_acctbal', 'public', 2), ('c_mktsegment', 'public', 0), ('c_dropped', 'public', 0)) AS v(column_name, classification, secret_level)) AS r"""


@query("safe_projection", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def safe_projection(t: Tables):
    return G.safe_projection(t.customer, t.spark.sql(REGISTRY), "customer")


TABLE_STATES = """
SELECT 't' || CAST(c_custkey AS STRING) AS table_name,
       split_part('db.example.org,gone.example.net,db.example.org:5432', ',', CAST(1 + c_custkey % 3 AS INT)) AS host,
       c_custkey % 5 <> 0 AS has_registry, c_custkey % 7 <> 0 AS source_active,
       CASE WHEN c_custkey % 2 = 0 THEN 'incremental' ELSE 'full_refresh' END AS load_mode,
       CASE WHEN c_custkey % 2 = 0 THEN 'c' || CAST(c_custkey * 10 AS STRING) END AS incremental_column
FROM {customer}"""
COLUMN_STATES = f"SELECT 't' || CAST(source_table_id AS STRING) AS table_name, column_name, classification, secret_level FROM ({E.CLASSES}) AS c"


@query(
    "load_decisions",
    ctes(t=TABLE_STATES, c=COLUMN_STATES)
    + """, n AS (SELECT table_name, count(*) AS pub, count(*) FILTER (WHERE classification = 'public' AND secret_level = 0) AS safe FROM c GROUP BY 1),
j AS (SELECT t.*, coalesce(pub, 0) AS pub, coalesce(safe, 0) AS safe,
  EXISTS (SELECT 1 FROM c WHERE c.table_name = t.table_name AND c.column_name = t.incremental_column AND classification = 'public' AND secret_level = 0) AS mark_safe
  FROM t LEFT JOIN n ON n.table_name = t.table_name),
r AS (SELECT *, CASE WHEN host LIKE 'gone%' THEN 'host is not permitted' WHEN NOT has_registry THEN 'source has no column registry'
  WHEN NOT source_active THEN 'table is inactive at its source' WHEN pub = 0 THEN 'table has no classified column'
  WHEN safe = 0 THEN 'none of ' || CAST(pub AS VARCHAR) || ' classified columns is safe'
  WHEN load_mode = 'incremental' AND NOT mark_safe THEN 'load mark ' || incremental_column || ' is not a safe column' END AS skip_reason FROM j)
SELECT table_name, CASE WHEN skip_reason IS NULL THEN 'load' ELSE 'skipped' END AS decision, skip_reason, safe AS columns_selected, pub - safe AS columns_excluded FROM r""",
)
def load_decisions(t: Tables):
    ok = guard.host_refusal(F.col("host"), ["gone.example.net"], ["db.example.org", "gone.example.net"]).isNull()
    return G.load_decisions(t.sql(TABLE_STATES), t.sql(COLUMN_STATES), ok)


@query(
    "type_mapping",
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  split_part('SmallInt|int4|bigint|numeric(12,2)|decimal|real|double precision|bool|date|timestamp with time zone|timestamp without time zone|uuid', '|', CAST(1 + l_partkey % 12 AS INT)) AS source_type FROM lineitem)
SELECT *, CASE lower(source_type) WHEN 'smallint' THEN 'smallint' WHEN 'int4' THEN 'int' WHEN 'bigint' THEN 'bigint' WHEN 'numeric(12,2)' THEN 'decimal(38,9)' WHEN 'decimal' THEN 'decimal(38,9)'
  WHEN 'real' THEN 'float' WHEN 'double precision' THEN 'double' WHEN 'bool' THEN 'boolean' WHEN 'date' THEN 'date' WHEN 'timestamp with time zone' THEN 'timestamp'
  WHEN 'timestamp without time zone' THEN 'timestamp_ntz' ELSE 'string' END AS target_type,
  CASE WHEN l_partkey % 12 IN (0, 1, 2, 3, 4, 5, 6) THEN 'numeric' WHEN l_partkey % 12 IN (8, 9, 10) THEN 'timestamp' ELSE 'text' END AS mark_type FROM s""",
)
def type_mapping(t: Tables):
    names = "SmallInt|int4|bigint|numeric(12,2)|decimal|real|double precision|bool|date|timestamp with time zone|timestamp without time zone|uuid"
    source = F.split_part(F.lit(names), F.lit("|"), (F.col("l_partkey") % 12 + 1).cast("int")).alias("source_type")
    typed = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", source)
    return typed.withColumns({"target_type": Y.spark_type_column(F.col("source_type")), "mark_type": Y.mark_type(F.col("source_type"))})


@query(
    "typed_cast",
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS balance, CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS name,
    CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 2 = 0 END AS even FROM customer""",
)
def typed_cast(t: Tables):
    blank = lambda n, c: F.when(F.col("c_custkey") % n == 0, "").otherwise(c.cast("string"))
    staged = t.customer.select(
        F.col("c_custkey").cast("string").alias("id"),
        blank(3, F.col("c_acctbal")).alias("balance"),
        blank(4, F.col("c_name")).alias("name"),
        blank(5, F.col("c_custkey") % 2 == 0).alias("even"),
    )
    return Y.typed(staged, {"id": "bigint", "balance": "double", "name": "string", "even": "boolean"})


@query(
    "routed_rows",
    """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'rejected' ELSE 'loaded' END AS route FROM events""",
)
def routed_rows(t: Tables):
    staged = t.events.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.when(F.col("event_id") % 4 == 0, "not a number").otherwise(F.col("value").cast("string")).alias("value"),
    )
    good, bad = Y.split_castable(staged, {"event_id": "bigint", "value": "double"})
    return good.select("event_id", F.lit("loaded").alias("route")).unionByName(
        bad.select(F.col("event_id").cast("bigint").alias("event_id"), F.lit("rejected").alias("route"))
    )


REVIEWS = """
SELECT o_custkey AS upload_id, o_orderkey AS position, CASE WHEN o_custkey % 17 = 0 THEN 'Bad suffix' ELSE 'sheet' END AS table_suffix,
       CASE WHEN o_orderkey % 71 = 0 THEN '1st' WHEN o_orderkey % 31 = 0 THEN 'same' ELSE 'c' || CAST(o_orderkey AS STRING) END AS name,
       CASE WHEN o_orderkey % 53 = 0 THEN 'XML' WHEN o_orderkey % 2 = 0 THEN 'integer' ELSE 'VARCHAR' END AS type,
       CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '3%' THEN 'public' ELSE 'sensitive' END AS classification
FROM {orders}"""


@query(
    "upload_reviews",
    ctes(r=REVIEWS)
    + """, e AS (SELECT *, CASE WHEN name = '1st' THEN 'invalid_column_name' WHEN type = 'XML' THEN 'unsupported_column_type' END AS err FROM r)
SELECT upload_id, CASE WHEN bool_or(table_suffix = 'Bad suffix') THEN 'invalid_table_suffix'
  WHEN count(err) > 0 THEN arg_min(err, position) FILTER (WHERE err IS NOT NULL)
  WHEN count(*) FILTER (WHERE classification = 'public') = 0 THEN 'no_public_column' WHEN count(*) > count(DISTINCT name) THEN 'duplicate_column_name' END AS error,
  count(*) FILTER (WHERE classification = 'public') AS included, count(*) FILTER (WHERE classification <> 'public') AS excluded FROM e GROUP BY 1""",
)
def upload_reviews(t: Tables):
    return profile.review_report(t.sql(REVIEWS))


@query(
    "reviewed_load",
    "SELECT c_custkey AS id, c_acctbal AS balance FROM customer",
)
def reviewed_load(t: Tables):
    staged = t.customer.select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").cast("string").alias("balance")
    )
    reviewed = {"id": ("bigint", "public"), "name": ("varchar", "sensitive"), "balance": ("DOUBLE", "public")}
    return profile.load_reviewed(staged, reviewed, "sheet")[0]


# -- search and lists -------------------------------------------------------


@query(
    "status_tabs",
    ctes(u=E.UPLOADS)
    + """SELECT org_unit, count(*) FILTER (WHERE status IN ('pending_review', 'loading')) AS pending_review,
  count(*) FILTER (WHERE status = 'registered') AS registered, count(*) FILTER (WHERE status = 'rejected') AS rejected FROM u GROUP BY 1""",
)
def status_tabs(t: Tables):
    tabs = search.status_counts(F.col("status"), ["pending_review", "registered", "rejected"])
    return t.sql(E.UPLOADS).groupBy("org_unit").agg(*tabs)


@query(
    "keyword_search",
    """SELECT p_partkey, p_name FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'red')
   AND contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'brand#1') AND p_type = 'ECONOMY'""",
)
def keyword_search(t: Tables):
    hit = search.matches_terms("RED  brand#1", [F.col(c) for c in ("p_name", "p_brand", "p_type")])
    return t.part.filter(hit & (F.col("p_type") == "ECONOMY")).select("p_partkey", "p_name")


@query("text_search", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'and')")
def text_search(t: Tables):
    return t.documents.filter(search.matches_terms("The and", [F.col("text")])).select("doc_id")


@query(
    "any_field_search",
    "SELECT c_custkey FROM customer WHERE contains(lower(c_name), '99') OR contains(lower(c_mktsegment), '99') OR contains(CAST(c_nationkey AS VARCHAR), '99')",
)
def any_field_search(t: Tables):
    fields = [F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey").cast("string")]
    return t.customer.filter(search.any_field_contains(" 99 ", fields)).select("c_custkey")


@query(
    "recent_windows",
    """SELECT event_type, count(*) FILTER (WHERE ts > m - INTERVAL 24 HOUR) AS last_day, count(*) FILTER (WHERE ts > m - INTERVAL 7 DAY) AS last_week,
    count(*) FILTER (WHERE ts > m - INTERVAL 10 MINUTE) AS last_minutes FROM events, (SELECT max(ts) AS m FROM events) GROUP BY 1""",
)
def recent_windows(t: Tables):
    as_of = t.events.agg(F.max("ts")).scalar()
    windows = {"last_day": "24 HOURS", "last_week": "7 DAYS", "last_minutes": "10 MINUTES"}
    counts = [F.count_if(search.since(F.col("ts"), as_of, w)).alias(n) for n, w in windows.items()]
    return t.events.groupBy("event_type").agg(*counts)


# -- guards and checks ------------------------------------------------------

DENIED, ALLOWED = ["example.net", "cheap-pills.example.com"], ["ththre.example.com", "m.theron.example.com", "blog.tionsh.example.net"]


@query(
    "source_guard",
    """WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/]+)', 1)) AS host FROM pages)
SELECT page_id, host, CASE WHEN host = '' THEN 'no host configured'
  WHEN host = 'example.net' OR ends_with(host, '.example.net') THEN 'host ' || host || ' is denied by example.net'
  WHEN host = 'cheap-pills.example.com' OR ends_with(host, '.cheap-pills.example.com') THEN 'host ' || host || ' is denied by cheap-pills.example.com'
  WHEN host NOT IN ('ththre.example.com', 'm.theron.example.com', 'blog.tionsh.example.net') THEN 'host ' || host || ' is not allowed' END AS reason FROM h""",
)
def source_guard(t: Tables):
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    hosts = t.pages.select("page_id", F.lower(host).alias("host"), F.concat(F.upper(host), F.when(host != "", F.lit(":5432")).otherwise("")).alias("raw"))
    return hosts.select("page_id", "host", guard.host_refusal(F.col("raw"), DENIED, ALLOWED).alias("reason"))


@query(
    "denied_by_suffix",
    """WITH h AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages), d AS (SELECT DISTINCT regexp_extract(url, '([^./]+[.][^./]+)(/|$)', 1) AS entry FROM pages WHERE page_id % 2 = 0)
SELECT host, entry FROM h JOIN d ON host = entry OR ends_with(host, '.' || entry)""",
)
def denied_by_suffix(t: Tables):
    hosts = t.pages.select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"))
    entries = t.pages.filter("page_id % 2 = 0").select(F.regexp_extract("url", "([^./]+[.][^./]+)(/|$)", 1).alias("entry"))
    return guard.denied_hosts(hosts, entries)


@query(
    "forbidden_targets",
    r"""WITH e AS (SELECT unnest(['example.net', 'Example.org']) AS entry UNION ALL SELECT 'site' || i || '.example' || CASE WHEN i % 2 = 0 THEN '.com' ELSE '' END FROM range(998) r(i)),
c AS (SELECT DISTINCT unnest(regexp_extract_all(html || ' ' || url, '(?i)(://|[Hh]ost=|[Ss]erver=|[Dd]ata [Ss]ource=|jdbc:[a-z]+:)[A-Za-z0-9._-]*', 0)) AS found FROM pages)
SELECT DISTINCT entry, regexp_extract(found, '(?i)^(://|[Hh]ost=|[Ss]erver=|[Dd]ata [Ss]ource=|jdbc:[a-z]+:)[A-Za-z0-9._-]*' || replace(entry, '.', '\.')) AS target
FROM c JOIN e ON contains(lower(found), lower(entry))
WHERE regexp_matches(found, '(?i)^(://|[Hh]ost=|[Ss]erver=|[Dd]ata [Ss]ource=|jdbc:[a-z]+:)[A-Za-z0-9._-]*' || replace(entry, '.', '\.'))""",
)
def forbidden_targets(t: Tables):
    """A list of a thousand entries, of which the pages hold a few."""
    page = t.pages.select(F.concat_ws(" ", "html", "url").alias("page"))
    listed = ["example.net", "Example.org", *[f"site{i}.example" + (".com" if i % 2 == 0 else "") for i in range(998)]]
    return guard.forbidden_targets(page, "page", listed)


@query(
    "forbidden_words",
    """SELECT doc_id, CASE WHEN contains(lower(text), 'password') THEN 'password' WHEN contains(lower(text), 'license') THEN 'License' WHEN contains(lower(text), 'eaux') THEN 'eaux' END AS word
FROM documents WHERE contains(lower(text), 'password') OR contains(lower(text), 'license') OR contains(lower(text), 'eaux')""",
)
def forbidden_words(t: Tables):
    word = guard.contains_any(F.col("text"), ["password", "License", "eaux"])
    return t.documents.select("doc_id", word.alias("word")).filter("word IS NOT NULL")


@query(
    "run_constraints",
    ctes(r=E.RUNS)
    + """SELECT run_id, 'skip_has_reason' AS rule FROM r WHERE NOT (status <> 'skipped' OR skip_reason IS NOT NULL)
UNION ALL SELECT run_id, 'failure_has_message' FROM r WHERE NOT (status <> 'failed' OR error_message IS NOT NULL)
UNION ALL SELECT run_id, 'finished_has_end' FROM r WHERE NOT (status = 'running' OR ended_at IS NOT NULL)
UNION ALL SELECT run_id, 'rows_not_few' FROM r WHERE NOT (rows_written >= 100)""",
)
def run_constraints(t: Tables):
    return G.violations(t.sql(E.RUNS), {**rules.runs(), "rows_not_few": F.col("rows_written") >= 100}, ["run_id"])


TABLE_ROWS = """
SELECT c_custkey, CASE WHEN c_custkey % 41 = 0 THEN 'hourly' WHEN c_custkey % 2 = 0 THEN 'incremental' ELSE 'full_refresh' END AS load_mode,
       CASE WHEN c_custkey % 2 = 0 AND c_custkey % 10 <> 0 THEN 'id' WHEN c_custkey % 51 = 0 THEN 'id' END AS incremental_column,
       c_custkey % 100 AS expire_snapshots_days, 7 AS orphan_retention_days,
       c_custkey AS port, CASE WHEN c_custkey % 8 = 0 THEN '  ' ELSE c_name END AS data_owner, 'law' AS lawful_basis,
       CASE WHEN c_custkey % 12 <> 0 THEN 'keep' END AS retention_note
FROM {customer}"""


@query(
    "source_constraints",
    ctes(r=TABLE_ROWS)
    + """SELECT c_custkey, 'load_mode_known' AS rule FROM r WHERE load_mode = 'hourly'
UNION ALL SELECT c_custkey, 'incremental_needs_column' FROM r WHERE NOT ((load_mode = 'incremental' AND incremental_column IS NOT NULL) OR (load_mode = 'full_refresh' AND incremental_column IS NULL))
UNION ALL SELECT c_custkey, 'retention_sane' FROM r WHERE expire_snapshots_days NOT BETWEEN 1 AND 3650
UNION ALL SELECT c_custkey, 'port_valid' FROM r WHERE port NOT BETWEEN 1 AND 65535
UNION ALL SELECT c_custkey, 'governance_stated' FROM r WHERE trim(data_owner) = '' OR retention_note IS NULL""",
)
def source_constraints(t: Tables):
    return G.violations(t.sql(TABLE_ROWS), {**rules.source_tables(), **rules.source_systems()}, ["c_custkey"])


RELEASE_ROWS = """
SELECT o_orderkey, CASE WHEN o_orderkey % 19 = 0 THEN 'Bad-Name' ELSE 't' || CAST(o_custkey AS STRING) END AS table_name, o_orderkey AS version,
       CASE WHEN o_orderkey % 23 = 0 THEN ' ' ELSE o_orderpriority END AS title, CASE WHEN o_orderkey % 29 = 0 THEN 'No Unit' ELSE 'eng' END AS owner_org_unit,
       split_part('student,weather,', ',', CAST(1 + o_orderkey % 3 AS INT)) AS domain_text, 'university' AS access_level, 'manual' AS refresh_cadence,
       CASE WHEN o_orderkey % 31 = 0 THEN 'a,b,c,d,e,f,g,h,i,j,k' ELSE 'a,b' END AS tag_text,
       CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'O' THEN 'requested' ELSE CASE WHEN o_orderkey % 9 = 0 THEN 'waiting' ELSE 'rejected' END END AS status,
       CASE WHEN o_orderkey % 37 <> 0 THEN 'u1' END AS decided_by, o_orderdate AS decided_at, CASE WHEN o_orderkey % 5 <> 0 THEN 'no' END AS rejection_reason,
       CASE WHEN o_orderkey % 7 <> 0 THEN '1' END AS source_version, '1' AS published_version, o_orderdate AS published_at,
       CASE WHEN o_orderkey % 43 = 0 THEN 'Copy failed!' END AS failure_code,
       repeat('t', CAST(o_orderkey % 220 AS INT)) AS title_en, repeat('d', CAST(o_orderkey % 2100 AS INT)) AS description,
       CASE WHEN o_orderkey % 3 = 0 THEN repeat('e', CAST(o_orderkey % 2050 AS INT)) END AS description_en, repeat('c', CAST(o_orderkey % 2020 AS INT)) AS changelog,
       o_orderkey % 53 - 1 AS row_count
FROM {orders}"""


@query(
    "release_constraints",
    ctes(r=RELEASE_ROWS)
    + """SELECT o_orderkey, 'table_name_shape' AS rule FROM r WHERE table_name = 'Bad-Name'
UNION ALL SELECT o_orderkey, 'org_unit_shape' FROM r WHERE owner_org_unit = 'No Unit'
UNION ALL SELECT o_orderkey, 'version_positive' FROM r WHERE version <= 0
UNION ALL SELECT o_orderkey, 'title_length' FROM r WHERE title = ' '
UNION ALL SELECT o_orderkey, 'domain_known' FROM r WHERE domain_text = 'weather'
UNION ALL SELECT o_orderkey, 'tags_bounded' FROM r WHERE len(tag_text) > 10
UNION ALL SELECT o_orderkey, 'decided' FROM r WHERE status <> 'requested' AND decided_by IS NULL
UNION ALL SELECT o_orderkey, 'rejection_has_reason' FROM r WHERE status = 'rejected' AND rejection_reason IS NULL
UNION ALL SELECT o_orderkey, 'published_is_pinned' FROM r WHERE status = 'published' AND source_version IS NULL
UNION ALL SELECT o_orderkey, 'failure_code_shape' FROM r WHERE failure_code IS NOT NULL
UNION ALL SELECT o_orderkey, 'title_en_bounded' FROM r WHERE length(title_en) > 200
UNION ALL SELECT o_orderkey, 'description_bounded' FROM r WHERE length(description) > 2000
UNION ALL SELECT o_orderkey, 'description_en_bounded' FROM r WHERE length(description_en) > 2000
UNION ALL SELECT o_orderkey, 'changelog_bounded' FROM r WHERE length(changelog) > 2000
UNION ALL SELECT o_orderkey, 'row_count_not_negative' FROM r WHERE row_count < 0
UNION ALL SELECT o_orderkey, 'status_known' FROM r WHERE status NOT IN ('requested', 'approved', 'published', 'failed', 'rejected')""",
)
def release_constraints(t: Tables):
    rows = t.sql(RELEASE_ROWS).withColumns({"tags": F.split("tag_text", ","), "domain": F.nullif("domain_text", F.lit(""))})
    return G.violations(rows, rules.releases(), ["o_orderkey"])


@query(
    "upload_constraints",
    """WITH r AS (SELECT event_id, event_id % 40 - 1 AS size_bytes, CASE WHEN event_type = 'view' THEN 'open' WHEN event_type = 'error' THEN 'loading' ELSE 'registered' END AS status,
 CASE WHEN event_id % 7 = 0 THEN 'Broken 7' WHEN event_id % 5 = 0 THEN 'bad_cell' END AS load_error FROM events)
SELECT event_id, 'size_positive' AS rule FROM r WHERE size_bytes <= 0 UNION ALL SELECT event_id, 'status_known' FROM r WHERE status = 'open' UNION ALL SELECT event_id, 'load_error_shape' FROM r WHERE load_error = 'Broken 7'""",
)
def upload_constraints(t: Tables):
    status = F.when(F.col("event_type") == "view", "open").when(F.col("event_type") == "error", "loading").otherwise("registered")
    error = F.when(F.col("event_id") % 7 == 0, "Broken 7").when(F.col("event_id") % 5 == 0, "bad_cell")
    rows = t.events.select("event_id", (F.col("event_id") % 40 - 1).alias("size_bytes"), status.alias("status"), error.alias("load_error"))
    return G.violations(rows, rules.uploads(), ["event_id"])


@query(
    "doubled_keys",
    """SELECT 'line' AS kind, CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR) AS name, count(*) AS copies FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'version', CAST(o_custkey AS VARCHAR) || '/' || CAST(o_orderkey % 9 AS VARCHAR), count(*) FROM orders GROUP BY o_custkey, o_orderkey % 9 HAVING count(*) > 1
UNION ALL SELECT 'address', lower(c_mktsegment) || '@' || c_nationkey, count(*) FROM customer WHERE c_custkey % 3 > 0 GROUP BY 2 HAVING count(*) > 1""",
)
def doubled_keys(t: Tables):
    """Keys that must be unique: of lines, of a table's releases, of accounts by their address in any case."""
    named = lambda df, kind, *cols: df.select(F.lit(kind).alias("kind"), F.concat_ws("/", *cols).alias("name"), "copies")
    lines = G.duplicates(t.lineitem, [F.col("l_orderkey"), F.col("l_linenumber")])
    versions = rules.doubled_versions(t.orders.select(F.col("o_custkey").alias("table_name"), (F.col("o_orderkey") % 9).alias("version")))
    segment = F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.upper("c_mktsegment"))
    address = F.when(F.col("c_custkey") % 3 > 0, F.concat(segment, F.lit("@"), F.col("c_nationkey").cast("string")))
    addresses = rules.doubled_addresses(t.customer.select(address.alias("email")))
    return named(lines, "line", "l_orderkey", "l_linenumber").unionByName(named(versions, "version", "table_name", "version")).unionByName(named(addresses, "address", "email"))


@query(
    "two_running",
    ctes(r=E.RUNS)
    + """SELECT 'run' AS kind, CAST(source_table_id AS VARCHAR) AS name, count(*) AS copies FROM r WHERE status = 'running' GROUP BY source_table_id HAVING count(*) > 1
UNION ALL SELECT 'release', 't' || o_custkey, count(*) FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY o_custkey HAVING count(*) > 1""",
)
def two_running(t: Tables):
    """Tables with two runs at once, and with two release requests that are open."""
    runs = G.duplicates(t.sql(E.RUNS), [F.col("source_table_id")], F.col("status") == "running")
    state = F.when(F.col("o_orderstatus") == "O", "requested").when(F.col("o_orderstatus") == "P", "approved").otherwise("published")
    releases = rules.open_releases(t.orders.select(F.concat(F.lit("t"), F.col("o_custkey").cast("string")).alias("table_name"), state.alias("status")))
    return runs.select(F.lit("run").alias("kind"), F.col("source_table_id").cast("string").alias("name"), "copies").unionByName(
        releases.select(F.lit("release").alias("kind"), F.col("table_name").alias("name"), "copies")
    )


PROFILED = {
    "o_orderkey": ("o_orderkey", "public"),
    "o_custkey": ("o_custkey", "public"),
    "o_orderstatus": ("o_orderstatus", "public"),
    "o_totalprice": ("o_totalprice", "public"),
    "o_orderdate": ("o_orderdate", "public"),
    "o_orderpriority": ("o_orderpriority", "public"),
    "Is Open?": ("is_open", "public"),
    "Wide Id": ("wide_id", "sensitive"),
    "\u0e27\u0e48\u0e32\u0e07": ("col_9", "public"),
}


def profile_sql() -> str:
    extra = {"Is Open?": "'1'", "Wide Id": "CAST(o_orderkey * 1000000007 AS VARCHAR)", list(PROFILED)[-1]: "''"}
    parts = []
    for position, (original, (name, label)) in enumerate(PROFILED.items(), start=1):
        value = f"nullif({extra.get(original, f'CAST({original} AS VARCHAR)')}, '')"
        parts.append(f"""SELECT CAST({position} AS INTEGER) AS position, '{original}' AS original_name, '{name}' AS name,
 CASE WHEN count({value}) = 0 THEN 'VARCHAR'
  WHEN bool_and(regexp_matches({value}, '^-?[0-9]+$')) THEN CASE WHEN max(abs(TRY_CAST({value} AS BIGINT))) > 2147483647 THEN 'BIGINT' ELSE 'INTEGER' END
  WHEN bool_and(regexp_matches({value}, '^-?[0-9]+([.][0-9]+)?$')) THEN 'DOUBLE' WHEN bool_and(regexp_matches(lower({value}), '^(true|false|t|f|1|0)$')) THEN 'BOOLEAN'
  WHEN bool_and(regexp_matches({value}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$')) THEN 'DATE'
  WHEN bool_and(regexp_matches({value}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[ T][0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}')) THEN 'TIMESTAMP' ELSE 'VARCHAR' END AS type,
 '{label}' AS classification FROM orders""")
    return "\nUNION ALL ".join(parts)


@query("column_profile", profile_sql())
def column_profile(t: Tables):
    extra = {"Is Open?": F.lit("1"), "Wide Id": (F.col("o_orderkey") * 1000000007).cast("string"), list(PROFILED)[-1]: F.lit("")}
    staged = t.orders.select(*[extra.get(c, F.col(f"`{c}`")).cast("string").alias(c) for c in PROFILED])
    return profile.column_profile(staged)


@query(
    "personal_columns",
    "SELECT c_custkey, CASE WHEN c_custkey % 4 IN (0, 1) THEN 'Email' ELSE 'users' END AS column_name FROM customer WHERE c_custkey % 4 IN (0, 1, 3)",
)
def personal_columns(t: Tables):
    """Each customer stands for one catalog column."""
    kind = F.col("c_custkey") % 4
    columns = t.customer.select(
        "c_custkey",
        F.when(kind < 2, "Email").otherwise("users").alias("column_name"),
        F.when(kind == 2, "bigint").otherwise("string").alias("data_type"),
    )
    return guard.personal_columns(columns, ["email", "users"], ["users"]).select("c_custkey", "column_name")


CATALOG_ROWS = [
    (table, column, kind, position)
    for table, columns in {
        "nation": "n_nationkey int,n_name string,n_regionkey int",
        "customer": "c_custkey bigint,c_name string,c_nationkey int,c_acctbal double,c_mktsegment string",
        "orders": "o_orderkey bigint,o_custkey bigint,o_orderstatus string,o_totalprice double,o_orderdate timestamp_ntz,o_orderpriority string",
    }.items()
    for position, (column, kind) in enumerate((c.split() for c in columns.split(",")), start=1)
]


@query(
    "catalog_metadata",
    f"""SELECT column_name, table_name, data_type, CAST(position AS INTEGER) AS position, CASE WHEN table_name = 'orders' THEN (SELECT count(*) FROM orders) END AS row_count
FROM (VALUES {', '.join(map(str, CATALOG_ROWS))}) AS v(table_name, column_name, data_type, position)""",
)
def catalog_metadata(t: Tables):
    """Columns of the given tables once they are registered in a catalog database."""
    t.spark.sql(f"CREATE DATABASE IF NOT EXISTS given LOCATION '{scratch_dir(t.spark, 'given')}'")
    for name in ("nation", "customer", "orders"):
        t.spark.sql(f"DROP TABLE IF EXISTS given.{name}")
        t.spark.catalog.createTable(f"given.{name}", path=f"{t.folder}/{name}.parquet", source="parquet")
    preview = S.release_preview(t.spark, "given", "orders").select("column_name", "row_count")
    return S.catalog_columns(t.spark, "given").join(preview, "column_name", "left")


UPLOAD_SQL = ctes(u=E.UPLOADS) + """, k AS (SELECT *, CASE WHEN lower(filename) LIKE '%.csv' THEN 'csv' WHEN lower(filename) LIKE '%.pdf' THEN 'pdf' WHEN lower(filename) LIKE '%.docx' THEN 'docx' END AS kind FROM u)
SELECT upload_id, kind, CASE WHEN size_bytes > 52428800 THEN 'file_too_large' WHEN org_unit = 'Bad Unit' THEN 'invalid_org_unit' WHEN kind IS NULL THEN 'unsupported_file_type' END AS refusal,
 'staging/uploads/' || org_unit || '/' || CAST(upload_id AS VARCHAR) || '/' || regexp_replace(filename, '[^A-Za-z0-9._-]', '_', 'g') AS object_key FROM k"""


@query("upload_triage", UPLOAD_SQL)
def upload_triage(t: Tables):
    name, unit = F.col("filename"), F.col("org_unit")
    return t.sql(E.UPLOADS).select(
        "upload_id",
        N.file_kind(name).alias("kind"),
        profile.upload_refusal(name, F.col("size_bytes"), unit).alias("refusal"),
        N.object_key(unit, F.col("upload_id"), name).alias("object_key"),
    )


@query(
    "identifier_names",
    r"""WITH n AS (SELECT p_partkey, regexp_replace(regexp_replace(lower(raw), '[^a-z0-9_]', '_', 'g'), '^_+|_+$', '', 'g') AS n, raw FROM
 (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '??' WHEN p_partkey % 3 = 0 THEN CAST(p_size AS VARCHAR) || p_name ELSE p_brand || ' (' || p_name || ')' END AS raw FROM part))
SELECT p_partkey, CASE WHEN regexp_matches(n, '^[a-z]') THEN n ELSE 'col_' || CASE WHEN n <> '' THEN n ELSE CAST(p_partkey AS VARCHAR) END END AS identifier,
 regexp_replace(raw, '[^\p{L}\p{N}._-]', '_', 'g') AS file_name FROM n""",
)
def identifier_names(t: Tables):
    raw = F.when(F.col("p_partkey") % 5 == 0, "??").when(F.col("p_partkey") % 3 == 0, F.concat(F.col("p_size").cast("string"), "p_name"))
    raw = raw.otherwise(F.concat("p_brand", F.lit(" ("), "p_name", F.lit(")")))
    return t.part.select("p_partkey", N.identifier(raw, F.col("p_partkey")).alias("identifier"), N.safe_file_name(raw).alias("file_name"))


RELEASE_FORMS = """
SELECT o_orderkey, CASE WHEN o_orderkey % 19 = 0 THEN 'Bad-Name' ELSE ' t' || CAST(o_custkey AS STRING) || ' ' END AS table_name,
  CASE WHEN o_orderkey % 23 = 0 THEN '  ' ELSE ' ' || o_orderpriority END AS title, CAST(NULL AS STRING) AS title_en, ' d ' AS description,
  ' ' || CAST(o_custkey AS STRING) AS description_en, CASE WHEN o_orderkey % 17 = 0 THEN repeat('c', 2001) WHEN o_orderkey % 2 = 0 THEN ' ' ELSE 'log ' END AS changelog,
  split_part('student,personnel,weather,', ',', CAST(1 + o_orderkey % 4 AS INT)) AS domain,
  CASE WHEN o_orderkey % 29 = 0 THEN 'no unit!' ELSE ' ENG ' END AS owner_org_unit, CASE WHEN o_orderkey % 3 = 0 THEN 'restricted' END AS access_level,
  CASE WHEN o_orderkey % 7 = 0 THEN 'hourly' END AS refresh_cadence,
  CASE WHEN o_orderkey % 11 = 0 THEN 'a,,b' WHEN o_orderkey % 13 = 0 THEN '1,2,3,4,5,6,7,8,9,10,11' ELSE 'x, y,x ,' || o_orderstatus END AS tag_text
FROM {orders}"""


@query(
    "release_requests",
    ctes(f=RELEASE_FORMS)
    + """SELECT o_orderkey, trim(table_name) AS table_name, trim(description_en) AS description_en, nullif(trim(changelog), '') AS changelog, lower(trim(owner_org_unit)) AS owner_org_unit, coalesce(access_level, 'university') AS access_level,
 CASE WHEN o_orderkey % 11 = 0 THEN 'a||b' WHEN o_orderkey % 13 = 0 THEN '1|2|3|4|5|6|7|8|9|10|11' ELSE 'x|y|' || right(tag_text, 1) END AS tags,
 CASE WHEN o_orderkey % 19 = 0 THEN 'invalid_table_name' WHEN trim(title) = '' THEN 'title_required' WHEN o_orderkey % 17 = 0 THEN 'invalid_text_field' WHEN domain = 'weather' THEN 'invalid_domain' WHEN o_orderkey % 29 = 0 THEN 'invalid_owner_org_unit'
  WHEN refresh_cadence IS NOT NULL THEN 'invalid_refresh_cadence' WHEN o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 THEN 'invalid_tags' END AS error FROM f""",
)
def release_requests(t: Tables):
    forms = t.sql(RELEASE_FORMS).withColumn("tags", F.split("tag_text", ",")).drop("tag_text")
    checked = profile.release_requests(forms)
    return checked.select("o_orderkey", "table_name", "description_en", "changelog", "owner_org_unit", "access_level", F.array_join("tags", "|").alias("tags"), "error")


# -- joins ------------------------------------------------------------------


@query(
    "ingest_plan",
    ctes(t=E.SOURCE_TABLES, s=E.SYSTEMS, m=E.MARKS)
    + """SELECT source_key, target_table, load_mode, mark FROM t JOIN s USING (source_system_id) LEFT JOIN m USING (source_table_id)
WHERE is_enabled AND system_enabled""",
)
def ingest_plan(t: Tables):
    plan = G.ingest_plan(t.sql(E.SOURCE_TABLES), t.sql(E.SYSTEMS), t.sql(E.MARKS))
    return plan.select("source_key", "target_table", "load_mode", "mark")


@query(
    "latest_run",
    """SELECT o_custkey, o_orderkey, o_orderstatus, o_orderdate FROM (
    SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1""",
)
def latest_run(t: Tables):
    return G.latest_by(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus", "o_orderdate"])


@query(
    "column_counts",
    ctes(t=E.SOURCE_TABLES, c=E.CLASSES)
    + """SELECT target_table, coalesce(n, 0) AS column_count, coalesce(safe, 0) AS safe_column_count FROM t LEFT JOIN
 (SELECT source_table_id, count(*) AS n, count(*) FILTER (WHERE classification = 'public' AND secret_level = 0) AS safe FROM c GROUP BY 1) x USING (source_table_id)""",
)
def column_counts(t: Tables):
    counted = t.sql(E.CLASSES).groupBy("source_table_id").agg(
        F.count("*").alias("n"), F.count_if(G.is_safe()).alias("safe")
    )
    joined = t.sql(E.SOURCE_TABLES).join(counted, "source_table_id", "left")
    return joined.select(
        "target_table", F.coalesce("n", F.lit(0)).alias("column_count"), F.coalesce("safe", F.lit(0)).alias("safe_column_count")
    )


@query(
    "maintenance_targets",
    ctes(t=E.SOURCE_TABLES, s=E.SYSTEMS, r=E.RUNS)
    + """SELECT target_table, optimize_enabled, expire_snapshots_days FROM t WHERE is_enabled AND source_system_id IN (SELECT source_system_id FROM s WHERE system_enabled)
 AND EXISTS (SELECT 1 FROM r WHERE r.source_table_id = t.source_table_id AND status = 'succeeded' AND rows_written > 0)""",
)
def maintenance_targets(t: Tables):
    targets = lifecycle.maintenance_targets(t.sql(E.SOURCE_TABLES), t.sql(E.SYSTEMS), t.sql(E.RUNS))
    return targets.select("target_table", "optimize_enabled", "expire_snapshots_days")


@query(
    "maintenance_plan",
    ctes(t=E.SOURCE_TABLES)
    + """SELECT target_table, 'optimize' AS action, NULL AS retention FROM t WHERE optimize_enabled
UNION ALL SELECT target_table, 'expire_snapshots', CAST(expire_snapshots_days AS VARCHAR) || 'd' FROM t
UNION ALL SELECT target_table, 'remove_orphan_files', CAST(orphan_retention_days AS VARCHAR) || 'd' FROM t""",
)
def maintenance_plan(t: Tables):
    return lifecycle.maintenance_plan(t.sql(E.SOURCE_TABLES), orphans=True)


@query("unregistered", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def unregistered(t: Tables):
    known = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return t.customer.join(known, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query(
    "seed_with_values",
    "SELECT n_name, mode, n_regionkey * 10 + rank AS seed FROM nation, (VALUES ('full_refresh', 1), ('incremental', 2)) AS v(mode, rank)",
)
def seed_with_values(t: Tables):
    """Two fixed rows per nation: an exploded literal, so no join at all."""
    seeds = F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(r).alias("rank")) for m, r in (("full_refresh", 1), ("incremental", 2))])
    rows = t.nation.select("n_name", "n_regionkey", F.inline(seeds))
    return rows.select("n_name", "mode", (F.col("n_regionkey") * 10 + F.col("rank")).alias("seed"))


TIER_SQL = ctes(a=E.ACCOUNTS) + """, g AS (SELECT username, access_tier, CASE access_tier WHEN 'viewer' THEN 'viewer,viewer_exec' WHEN 'analyst' THEN 'analyst' WHEN 'admin' THEN 'admin' END AS groups
 FROM a WHERE is_active AND access_tier <> 'none')"""


@query("tier_groups", TIER_SQL + "SELECT * FROM g")
def tier_groups(t: Tables):
    tiers = policy.tier_groups(t.sql(E.ACCOUNTS))
    return tiers.withColumn("groups", F.array_join("groups", ","))


@query(
    "group_members",
    TIER_SQL + "SELECT unnest(string_split(groups, ',')) AS group_name, username FROM g WHERE username NOT IN (SELECT lower(c_name) FROM customer WHERE c_custkey % 13 = 0)",
)
def group_members(t: Tables):
    reserved = t.customer.filter("c_custkey % 13 = 0").select(F.lower("c_name").alias("username"))
    return G.members(policy.tier_groups(t.sql(E.ACCOUNTS)), reserved)


@query(
    "member_lines",
    TIER_SQL
    + """, m AS (SELECT unnest(string_split(groups, ',')) AS group_name, username FROM g), b AS (SELECT DISTINCT group_name, unnest(['zz_service', 'customer#000000006', 'superset']) AS username, unnest([1, 2, 3]) AS place FROM m WHERE group_name LIKE 'viewer%'),
o AS (SELECT group_name, username, min(place) AS place FROM (SELECT group_name, username, 999 AS place FROM m UNION ALL SELECT * FROM b) GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY group_name ORDER BY place, username) - 1 AS n FROM o)
SELECT group_name, CAST(floor(n / 50) AS INT) AS line, CAST(count(*) AS INT) AS size, string_agg(username, ',' ORDER BY n) AS members FROM n GROUP BY 1, 2""",
)
def member_lines(t: Tables):
    """Base members first, in their own order, then the granted ones by name."""
    nobody = t.customer.limit(0).select(F.col("c_name").alias("username"))
    grants = G.members(policy.tier_groups(t.sql(E.ACCOUNTS)), nobody)
    first = F.posexplode(F.array(*map(F.lit, ["zz_service", "customer#000000006", "superset"])))
    base = grants.filter("group_name LIKE 'viewer%'").select("group_name").distinct().select("group_name", first.alias("place", "username"))
    return G.member_lines(grants, 50, base)


@query(
    "composite_join",
    "SELECT l_orderkey, l_linenumber, a.l_partkey, x.lines FROM lineitem a JOIN (SELECT l_orderkey, l_linenumber, count(*) AS lines FROM lineitem GROUP BY 1, 2) x USING (l_orderkey, l_linenumber)",
)
def composite_join(t: Tables):
    keys = ["l_orderkey", "l_linenumber"]
    counted = t.lineitem.groupBy(*keys).agg(F.count("*").alias("lines"))
    return t.lineitem.select(*keys, "l_partkey").join(counted, keys)


@query(
    "derived_key_join",
    "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON 'raw.t' || CAST(c_custkey AS VARCHAR) = 'raw.t' || CAST(o_custkey AS VARCHAR)",
)
def derived_key_join(t: Tables):
    name = lambda c: F.concat_ws(".", F.lit("raw"), F.concat(F.lit("t"), F.col(c).cast("string"))).alias("name")
    return t.customer.select("c_custkey", name("c_custkey")).join(t.orders.select("o_orderkey", name("o_custkey")), "name").drop("name")


@query(
    "fill_nulls",
    ctes(d=E.DETAILS)
    + """SELECT source_table_id, coalesce(d.title, n.title) AS title, coalesce(d.domain, n.domain) AS domain FROM d LEFT JOIN
 (SELECT c_custkey AS k, 'T' || c_name AS title, 'filled' AS domain FROM customer WHERE c_custkey % 2 = 0) n ON k = source_table_id""",
)
def fill_nulls(t: Tables):
    old = t.sql(E.DETAILS).select("source_table_id", "title", "domain")
    labels = t.customer.filter("c_custkey % 2 = 0").select(
        F.col("c_custkey").alias("source_table_id"), F.concat(F.lit("T"), "c_name").alias("title"), F.lit("filled").alias("domain")
    )
    return G.fill_nulls(old, labels, ["source_table_id"], ["title", "domain"])


@query(
    "name_intersection",
    ctes(c=E.CLASSES)
    + "SELECT column_name FROM c WHERE classification = 'public' AND secret_level = 0 AND column_name IN (SELECT 'c' || CAST(l_orderkey AS VARCHAR) FROM lineitem)",
)
def name_intersection(t: Tables):
    published = t.lineitem.select(F.concat(F.lit("c"), F.col("l_orderkey").cast("string")).alias("column_name")).distinct()
    return t.sql(E.CLASSES).filter(G.is_safe()).select("column_name").join(published, "column_name", "left_semi")


@query(
    "upsert_rows",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0""",
)
def upsert_rows(t: Tables):
    rows = t.customer.select("c_custkey", "c_acctbal")
    new = rows.filter("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1)
    return G.upsert(rows.filter("c_custkey % 2 = 0"), new, ["c_custkey"])


@query("insert_absent", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'seed' END AS c_name FROM customer")
def insert_absent(t: Tables):
    rows = t.customer.select("c_custkey", "c_name")
    return G.insert_absent(rows.filter("c_custkey % 2 = 0"), rows.withColumn("c_name", F.lit("seed")), ["c_custkey"])


# -- freshness and catalogue ------------------------------------------------

FRESH = ctes(t=E.SOURCE_TABLES, s=E.SYSTEMS, r=E.RUNS, d=E.DETAILS, c=E.CLASSES) + f""",
ok AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_table_id ORDER BY started_at DESC, run_id DESC) AS n FROM r WHERE status = 'succeeded') WHERE n = 1),
al AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_table_id ORDER BY started_at DESC, run_id DESC) AS n FROM r) WHERE n = 1),
f AS (SELECT t.source_table_id, target_table, source_key, load_mode, is_enabled, ok.started_at AS last_success_started_at, ok.rows_written AS last_success_rows,
  al.status AS last_status, al.started_at AS last_attempt_started_at, al.skip_reason,
  CAST(round(date_diff('second', ok.started_at, {LAST}) / 3600.0, 1) AS DOUBLE) AS age_since_last_success_hours
  FROM t JOIN s USING (source_system_id) LEFT JOIN ok ON ok.source_table_id = t.source_table_id LEFT JOIN al ON al.source_table_id = t.source_table_id),
n AS (SELECT source_table_id, count(*) AS column_count, count(*) FILTER (WHERE classification = 'public' AND secret_level = 0) AS safe FROM c GROUP BY 1),
k AS (SELECT f.source_table_id, target_table AS dataset_key, coalesce(title, target_table) AS title, coalesce(title_en, title, target_table) AS title_en, coalesce(domain, 'unsorted') AS domain,
  data_owner, load_mode, is_enabled, CASE WHEN NOT is_enabled THEN 'retired' WHEN last_success_started_at IS NOT NULL THEN 'published' WHEN last_status = 'skipped' THEN 'withheld' ELSE 'pending' END AS availability,
  last_success_started_at, last_success_rows, last_status, coalesce(column_count, 0) AS column_count, coalesce(safe, 0) AS safe_column_count, coalesce(column_count, 0) - coalesce(safe, 0) AS withheld_column_count
  FROM f JOIN d ON d.source_table_id = f.source_table_id LEFT JOIN n ON n.source_table_id = f.source_table_id)
"""


def fresh(t: Tables):
    return G.freshness(t.sql(E.SOURCE_TABLES), t.sql(E.SYSTEMS), t.sql(E.RUNS), last_order(t))


def catalog(t: Tables):
    return G.catalogue(fresh(t), t.sql(E.DETAILS), t.sql(E.CLASSES))


@query("table_freshness", FRESH + "SELECT * FROM f")
def table_freshness(t: Tables):
    return fresh(t).withColumn("age_since_last_success_hours", F.col("age_since_last_success_hours").cast("double"))


@query("portal_catalogue", FRESH + "SELECT * FROM k")
def portal_catalogue(t: Tables):
    return catalog(t)


@query(
    "catalogue_stats",
    FRESH
    + f"""SELECT count(*) AS datasets_total, count(*) FILTER (WHERE availability = 'published') AS datasets_published, count(DISTINCT data_owner) AS data_owners,
 count(*) FILTER (WHERE last_success_started_at > {LAST} - INTERVAL 24 HOUR) AS fresh_within_24h, CAST(coalesce(sum(withheld_column_count), 0) AS BIGINT) AS columns_withheld,
 (SELECT count(*) FROM r WHERE status = 'succeeded' AND started_at > {LAST} - INTERVAL 7 DAY) AS runs_succeeded_7d, (SELECT count(*) FROM r WHERE started_at > {LAST} - INTERVAL 7 DAY) AS runs_total_7d FROM k""",
)
def catalogue_stats(t: Tables):
    return G.catalogue_stats(catalog(t), t.sql(E.RUNS), last_order(t))


DOMAINS = [("building", "Building", 1), ("household", "Household", 2), ("machinery", "Machinery", 3), ("empty", "Empty", 4), ("unsorted", "Unsorted", 5)]


def domains(t: Tables):
    return t.spark.createDataFrame(DOMAINS, "key string, label string, sort_order int")


@query(
    "domain_counts",
    FRESH
    + f"""SELECT l."key", l.label, l.sort_order, count(k.dataset_key) AS dataset_count, count(*) FILTER (WHERE availability = 'published') AS published_count
FROM (VALUES {', '.join(map(str, DOMAINS))}) AS l("key", label, sort_order) LEFT JOIN k ON k.domain = l."key" GROUP BY 1, 2, 3 HAVING count(k.dataset_key) > 0 OR l."key" <> 'unsorted'""",
)
def domain_counts(t: Tables):
    return G.domain_counts(domains(t), catalog(t))


MERGE = """, p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY version DESC) AS n FROM rel WHERE status = 'published') WHERE n = 1),
w AS (SELECT CASE WHEN CAST(substr(table_name, 2) AS INT) % 2 = 0 THEN 'raw.t' || substr(table_name, 2) ELSE 'published.' || table_name END AS dataset_key, title, 'building' AS domain, row_count FROM p),
mg AS (SELECT coalesce(w.dataset_key, k.dataset_key) AS dataset_key, CASE WHEN w.dataset_key IS NOT NULL THEN w.title ELSE k.title END AS title,
 CASE WHEN w.dataset_key IS NOT NULL THEN w.domain ELSE k.domain END AS domain, CASE WHEN w.dataset_key IS NOT NULL THEN w.row_count ELSE k.last_success_rows END AS last_success_rows, k.dataset_key IS NULL AS is_new
 FROM k FULL OUTER JOIN w ON w.dataset_key = k.dataset_key)
"""


def merged(t: Tables):
    latest = latest_release(t)
    number = F.substr("table_name", F.lit(2))
    key = F.when(number.cast("int") % 2 == 0, F.concat(F.lit("raw.t"), number)).otherwise(F.concat(F.lit("published."), "table_name"))
    releases = latest.select(key.alias("dataset_key"), "title", F.lit("building").alias("domain"), F.col("row_count").alias("last_success_rows"))
    return G.merge_releases(catalog(t), releases, ["title", "domain", "last_success_rows"])


@query("catalogue_merge", FRESH.rstrip() + f", rel AS ({E.RELEASES})" + MERGE + "SELECT * FROM mg")
def catalogue_merge(t: Tables):
    return merged(t)


@query(
    "bumped_domains",
    FRESH.rstrip()
    + f", rel AS ({E.RELEASES})"
    + MERGE
    + """SELECT domain AS "key", count(*) + CASE WHEN domain = 'building' THEN (SELECT count(*) FROM mg WHERE is_new) ELSE 0 END AS dataset_count,
 count(*) FILTER (WHERE availability = 'published') + CASE WHEN domain = 'building' THEN (SELECT count(*) FROM mg WHERE is_new) ELSE 0 END AS published_count
 FROM k WHERE domain IN ('building', 'household', 'machinery', 'unsorted') GROUP BY domain
UNION ALL SELECT 'empty', 0, 0""",
)
def bumped_domains(t: Tables):
    return G.bump_domains(G.domain_counts(domains(t), catalog(t)), merged(t))


@query(
    "catalogue_json",
    FRESH
    + """SELECT '{"dataset_key":"' || dataset_key || '","title":"' || title || '","domain":"' || domain || '","availability":"' || availability || '","last_success_at":'
 || coalesce('"' || strftime(last_success_started_at, '%Y-%m-%dT%H:%M:%SZ') || '"', 'null') || ',"rows":' || coalesce(CAST(last_success_rows AS VARCHAR), 'null') || '}' AS json FROM k""",
)
def catalogue_json(t: Tables):
    rows = catalog(t).select(
        "dataset_key", "title", "domain", "availability",
        M.iso_utc(F.col("last_success_started_at")).alias("last_success_at"), F.col("last_success_rows").alias("rows"),
    )
    return documents.json_rows(rows)


@query(
    "run_report",
    ctes(r=E.RUNS)
    + f"""SELECT run_id, status, coalesce(rows_written, 0) AS rows_written, left(coalesce(skip_reason, error_message, ''), 64) AS note
 FROM r WHERE started_at > {LAST} - INTERVAL 30 DAY""",
)
def run_report(t: Tables):
    recent = t.sql(E.RUNS).filter(search.since(F.col("started_at"), last_order(t), "30 DAYS"))
    note = F.left(M.first_filled(F.col("skip_reason"), F.col("error_message"), F.lit(" ")), F.lit(64))
    return recent.select("run_id", "status", F.coalesce("rows_written", F.lit(0)).alias("rows_written"), F.trim(note).alias("note"))


@query(
    "recent_runs",
    ctes(r=E.RUNS) + "SELECT run_id, source_table_id, status, started_at FROM r ORDER BY started_at DESC, run_id LIMIT 200",
)
def recent_runs(t: Tables):
    return t.sql(E.RUNS).orderBy(F.desc("started_at"), "run_id").select("run_id", "source_table_id", "status", "started_at").limit(200)


# -- releases ---------------------------------------------------------------


def latest_release(t: Tables):
    published = t.sql(E.RELEASES).filter("status = 'published'")
    return G.latest_by(published, ["table_name"], ["version"], ["version", "title", "row_count", "requested_at"])


@query(
    "latest_release",
    ctes(r=E.RELEASES)
    + "SELECT table_name, version, title, row_count, requested_at FROM (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY version DESC) AS n FROM r WHERE status = 'published') WHERE n = 1",
)
def latest_release_query(t: Tables):
    return latest_release(t)


@query(
    "next_versions",
    """WITH hi AS (SELECT o_orderstatus AS table_name, max(o_orderkey) AS highest FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1),
q AS (SELECT o_orderstatus AS table_name, o_orderdate, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS n FROM orders)
SELECT q.table_name, o_orderdate, o_orderkey, coalesce(highest, 0) + n AS version FROM q LEFT JOIN hi ON hi.table_name = q.table_name""",
)
def next_versions(t: Tables):
    """Three tables share all requests: each holds about a third of the rows."""
    requests = t.orders.withColumnRenamed("o_orderstatus", "table_name")
    releases = requests.filter("table_name <> 'P'").select("table_name", F.col("o_orderkey").alias("version"))
    return G.next_versions(requests, releases, ["o_orderdate", "o_orderkey"])


@query(
    "release_board",
    ctes(r=E.RELEASES)
    + "SELECT table_name, version, status FROM r WHERE requested_by = 'u7' ORDER BY CASE status WHEN 'requested' THEN 0 WHEN 'approved' THEN 1 ELSE 2 END, requested_at DESC, version LIMIT 200",
)
def release_board(t: Tables):
    rank = F.when(F.col("status") == "requested", 0).when(F.col("status") == "approved", 1).otherwise(2)
    mine = t.sql(E.RELEASES).filter("requested_by = 'u7'")
    return mine.orderBy(rank, F.desc("requested_at"), "version").select("table_name", "version", "status").limit(200)


# -- access -----------------------------------------------------------------


@query(
    "row_filter",
    "SELECT c_custkey, lower(c_mktsegment) AS org_unit FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
)
def row_filter(t: Tables):
    table = t.customer.select("c_custkey", F.lower("c_mktsegment").alias("org_unit"))
    return policy.secured(table, "customer", "published", ["viewer", "viewer_org_building", "viewer_org_machinery"], ["customer"])


@query(
    "row_filter_bulk",
    ctes(a=E.ACCOUNTS)
    + """SELECT r_name AS username, n_nationkey, CAST(count(*) AS BIGINT) AS visible FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
)
def row_filter_bulk(t: Tables):
    """Every region is a member who may see the rows of its nations."""
    grants = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("r_name").alias("username"), F.col("n_nationkey").alias("org_unit")
    )
    rows = t.customer.select("c_custkey", F.col("c_nationkey").alias("org_unit"))
    seen = policy.secured_for_all(rows, grants)
    return seen.groupBy("username", F.col("org_unit").alias("n_nationkey")).agg(F.count("*").alias("visible"))


CONTROL_SQL = ", ".join(f"'{o}'" for o in policy.CONTROL)
ACCESS = ctes(q=E.REQUESTS) + f""", g AS (SELECT *, string_split(groups_text, ',') AS gr, operation = 'SelectFromColumns' AS is_read, table_name IS NOT NULL AS tab,
 table_name IS NOT NULL AND catalog_name = 'lake' AS lake, operation IN ({CONTROL_SQL}) AS control FROM q)
SELECT event_id, coalesce(
  list_contains(gr, 'admin') OR (user_name = 'dashboard' AND operation = 'ImpersonateUser')
  OR (list_contains(gr, 'ingestion') AND ((lake AND schema_name IN ('raw', 'curated', 'documents')) OR (tab AND catalog_name = 'staging' AND schema_name = 'raw_staging')
      OR (tab AND is_read AND catalog_name IN ('lake', 'staging') AND schema_name = 'information_schema') OR control OR (operation = 'CreateSchema' AND catalog_name IN ('lake', 'staging'))))
  OR (list_contains(gr, 'analyst') AND ((lake AND is_read AND schema_name IN ('curated', 'published', 'information_schema'))
      OR (lake AND schema_name = 'curated' AND operation IN ('InsertIntoTable', 'UpdateTableColumns', 'DeleteFromTable', 'CreateTable', 'DropTable'))
      OR (lake AND is_read AND schema_name = 'raw' AND starts_with(table_name, 'steward_')) OR (tab AND is_read AND catalog_name = 'platform' AND schema_name IN ('ingest', 'information_schema')) OR control))
  OR (list_contains(gr, 'viewer') AND ((lake AND is_read AND schema_name = 'published' AND len(gr) > 1) OR (lake AND is_read AND schema_name = 'information_schema') OR control))
  OR (list_contains(gr, 'steward') AND ((lake AND is_read AND schema_name IN ('curated', 'published') AND len(gr) > 1) OR (lake AND is_read AND schema_name = 'information_schema') OR control))
  OR (list_contains(gr, 'publisher') AND ((lake AND is_read AND schema_name IN ('curated', 'published', 'information_schema'))
      OR (lake AND schema_name = 'published' AND operation IN ('CreateTable', 'DropTable', 'InsertIntoTable')) OR control))
  OR (list_contains(gr, 'maintenance') AND ((lake AND schema_name IN ('raw', 'curated', 'published') AND operation IN ('ExecuteTableProcedure', 'AlterTableExecute', 'InsertIntoTable', 'DeleteFromTable'))
      OR (lake AND is_read AND schema_name = 'information_schema') OR (lake AND is_read AND schema_name IN ('raw', 'curated', 'published') AND n_columns = 0) OR control
      OR (operation = 'SetCatalogSessionProperty' AND catalog_name = 'lake' AND property = 'expire_snapshots_min_retention'))), false) AS allow FROM g"""


@query("access_matrix", ACCESS)
def access_matrix(t: Tables):
    q = t.sql(E.REQUESTS)
    columns = F.when(F.col("n_columns") > 0, F.array(F.lit("c"))).otherwise(F.array().cast("array<string>"))
    requests = q.select(
        "event_id", F.col("user_name").alias("user"), F.split("groups_text", ",").alias("groups"), "operation",
        F.col("catalog_name").alias("catalog"), F.col("schema_name").alias("schema"), F.col("table_name").alias("table"),
        columns.alias("columns"), "property",
    )
    return policy.decide(requests).select("event_id", "allow")


MOVED = "access_tier IN ('viewer_exec', 'steward') OR (access_tier = 'viewer' AND org_unit IS NOT NULL)"


@query(
    "tier_migration",
    ctes(a=E.ACCOUNTS)
    + f"""SELECT username, CASE WHEN {MOVED} THEN 'viewer' ELSE access_tier END AS access_tier, CASE WHEN {MOVED} THEN NULL ELSE org_unit END AS org_unit,
 access_tier AS tier_before, org_unit AS unit_before FROM a""",
)
def tier_migration(t: Tables):
    """The migrated accounts, next to what the audit rows bring back."""
    accounts = t.sql(E.ACCOUNTS)
    moved, audit = policy.migrate_tiers(accounts)
    back = policy.revert_tiers(moved, audit)
    return moved.select("username", "access_tier", "org_unit").join(
        back.select("username", F.col("access_tier").alias("tier_before"), F.col("org_unit").alias("unit_before")), "username"
    )


@query(
    "tier_audit",
    ctes(a=E.ACCOUNTS)
    + f"""SELECT username, 'account_updated' AS action, '{{"reason":"three_tiers","before":{{"access_tier":"' || access_tier || '","org_unit":' || coalesce('"' || org_unit || '"', 'null') || ',"is_active":' || CAST(is_active AS VARCHAR)
 || '}},"after":{{"access_tier":"viewer","org_unit":null,"is_active":' || CAST(is_active AS VARCHAR) || '}}}}' AS detail FROM a WHERE {MOVED}""",
)
def tier_audit(t: Tables):
    return policy.migrate_tiers(t.sql(E.ACCOUNTS))[1]


# -- lifecycle --------------------------------------------------------------


@query(
    "claimable_tables",
    ctes(t=E.SOURCE_TABLES, r=E.RUNS) + "SELECT target_table FROM t WHERE source_table_id NOT IN (SELECT source_table_id FROM r WHERE status = 'running')",
)
def claimable_tables(t: Tables):
    return lifecycle.claimable(t.sql(E.SOURCE_TABLES), t.sql(E.RUNS)).select("target_table")


@query(
    "stale_runs",
    ctes(r=E.RUNS)
    + f""", s AS (SELECT *, status = 'running' AND started_at < {LAST} - INTERVAL 90 DAY AS stale FROM r)
SELECT run_id, CASE WHEN stale THEN 'failed' ELSE status END AS status, CASE WHEN stale THEN {LAST} ELSE ended_at END AS ended_at,
 CASE WHEN stale THEN 'abandoned: still in progress after 90 days' ELSE error_message END AS error_message FROM s""",
)
def stale_runs(t: Tables):
    closed = lifecycle.close_stale(t.sql(E.RUNS), last_order(t), "90 days")
    return closed.select("run_id", "status", "ended_at", "error_message")


@query(
    "interrupted_uploads",
    ctes(u=E.UPLOADS)
    + "SELECT upload_id, CASE WHEN status = 'loading' THEN 'pending_review' ELSE status END AS status, CASE WHEN status = 'loading' THEN 'interrupted' END AS load_error FROM u",
)
def interrupted_uploads(t: Tables):
    rows = t.sql(E.UPLOADS).select("upload_id", "status", F.lit(None).cast("string").alias("load_error"))
    return lifecycle.interrupted(rows, "loading", "pending_review", "interrupted", "load_error")


@query(
    "retention_purge",
    """SELECT 'sessions' AS name, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-20 00:00:00') AS removed FROM events
UNION ALL SELECT 'login_events', count(*) FILTER (WHERE o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 180 DAY) FROM orders
UNION ALL SELECT 'accounts', count(*) FILTER (WHERE l_shipdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 24 MONTH) FROM lineitem""",
)
def retention_purge(t: Tables):
    as_of = last_order(t)
    sessions = lifecycle.purge_report({"sessions": (t.events, "ts", None)}, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    aged = {"login_events": (t.orders, "o_orderdate", "180 DAYS"), "accounts": (t.lineitem, "l_shipdate", "24 MONTHS")}
    return sessions.unionByName(lifecycle.purge_report(aged, as_of))


@query(
    "retained_orders",
    "SELECT o_orderkey FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 180 DAY",
)
def retained_orders(t: Tables):
    return lifecycle.purge(t.orders, "o_orderdate", last_order(t), "180 DAYS").select("o_orderkey")


def replay_sql(actions: str, key: str, event: str, machine, code: str | None = None) -> str:
    """The same history walked one action at a time."""
    moves = " ".join(f"WHEN '{s}/{a}' THEN '{n}'" for (s, a), n in machine.items())
    known = ", ".join(f"'{s}/{a}'" for s, a in machine)
    applied = f"w.status || '/' || o.action IN ({known})"
    started, kept, given = (", CAST(NULL AS VARCHAR) AS code", f", CASE WHEN {applied} THEN coalesce({code}, w.code) ELSE w.code END", ", nullif(arg_max_null(code, n), '') AS code") if code else ("", "", "")
    return f"""WITH RECURSIVE a AS ({actions}),
o AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {event}) AS n FROM a),
w AS (SELECT {key}, CAST(0 AS BIGINT) AS n, 'new' AS status, CAST(0 AS BIGINT) AS applied{started} FROM (SELECT DISTINCT {key} FROM a)
 UNION ALL SELECT w.{key}, o.n, CASE w.status || '/' || o.action {moves} ELSE w.status END,
  w.applied + CASE WHEN {applied} THEN 1 ELSE 0 END{kept} FROM w JOIN o ON o.{key} = w.{key} AND o.n = w.n + 1)
SELECT {key}, arg_max(status, n) AS status, max(applied) AS applied, max(n) - max(applied) AS refused{given} FROM w GROUP BY 1"""


@query("upload_lifecycle", replay_sql(E.ACTIONS, "upload_id", "event_id", lifecycle.UPLOAD))
def upload_lifecycle(t: Tables):
    return lifecycle.replay(t.sql(E.ACTIONS), lifecycle.UPLOAD, ["upload_id"], ["event_id"])


RUN_ACTIONS = """
SELECT l_orderkey AS run_id, l_partkey * 10000 + l_suppkey * 10 + l_linenumber AS event_id,
       split_part('claim,claim,skip,fail,succeed', ',', CAST(1 + (l_partkey + l_linenumber) % 5 AS INT)) AS action
FROM {lineitem}"""


@query("run_lifecycle", replay_sql(RUN_ACTIONS, "run_id", "event_id", lifecycle.RUN))
def run_lifecycle(t: Tables):
    return lifecycle.replay(t.sql(RUN_ACTIONS), lifecycle.RUN, ["run_id"], ["event_id"])


# A customer's orders are what happened to one release; its own requester may not reject it.
RELEASE_ACTIONS = """
SELECT o_custkey AS release_id, o_orderkey AS event_id, 'u' || CAST(o_orderkey % 3 AS STRING) AS actor, 'u' || CAST(o_custkey % 3 AS STRING) AS requested_by,
       split_part('request,approve,reject,publish,fail,interrupted', ',', CAST(1 + o_orderkey % 6 AS INT)) AS action
FROM {orders}"""


@query(
    "release_lifecycle",
    replay_sql(
        f"SELECT release_id, event_id, CASE WHEN action = 'reject' AND actor = requested_by THEN 'reject_own' ELSE action END AS action FROM ({RELEASE_ACTIONS})",
        "release_id", "event_id", lifecycle.RELEASE, "CASE o.action WHEN 'fail' THEN 'copy_' || o.event_id % 7 WHEN 'interrupted' THEN 'interrupted' WHEN 'publish' THEN '' END",
    ),
)
def release_lifecycle(t: Tables):
    events = t.sql(RELEASE_ACTIONS)
    action = lifecycle.decision(F.col("action"), F.col("actor"), F.col("requested_by"))
    failed = F.when(F.col("action") == "fail", F.concat(F.lit("copy_"), (F.col("event_id") % 7).cast("string")))
    code = failed.when(F.col("action") == "interrupted", "interrupted").when(F.col("action") == "publish", "")
    return lifecycle.replay(events.withColumn("action", action), lifecycle.RELEASE, ["release_id"], ["event_id"], code)
