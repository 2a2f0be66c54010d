"""Control-plane tables derived from the given ones, in SQL both engines understand.

Customers stand for registered tables, nations for source systems, orders for
runs, published columns and releases, events for uploads and attempts.
"""

SYSTEMS = """
SELECT n_nationkey AS source_system_id, lower(n_name) AS source_key, n_name AS display_name,
       n_nationkey % 5 <> 0 AS system_enabled, n_regionkey AS region_key
FROM {nation}"""

SOURCE_TABLES = """
SELECT c_custkey AS source_table_id, c_nationkey AS source_system_id,
       'raw.t' || CAST(c_custkey AS STRING) AS target_table,
       CASE WHEN c_custkey % 10 = 0 THEN 'incremental' ELSE 'full_refresh' END AS load_mode,
       c_custkey % 7 <> 0 AS is_enabled, c_custkey % 4 <> 0 AS optimize_enabled,
       1 + c_custkey % 30 AS expire_snapshots_days, 1 + c_custkey % 9 AS orphan_retention_days
FROM {customer}"""

DETAILS = """
SELECT c_custkey AS source_table_id,
       CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS title,
       CASE WHEN c_custkey % 4 = 0 THEN upper(c_name) END AS title_en,
       CASE WHEN c_custkey % 9 <> 0 THEN lower(c_mktsegment) END AS domain,
       'owner ' || CAST(c_nationkey AS STRING) AS data_owner
FROM {customer}"""

RUNS = """
SELECT o_orderkey AS run_id, o_custkey AS source_table_id, o_orderdate AS started_at,
       CASE WHEN o_orderstatus = 'F' THEN 'succeeded'
            WHEN o_orderstatus = 'P' THEN 'running'
            WHEN o_orderkey % 3 = 0 THEN 'skipped'
            ELSE 'failed' END AS status,
       CASE WHEN o_orderstatus = 'F' THEN CAST(floor(o_totalprice / 1000) AS BIGINT) END AS rows_written,
       CASE WHEN o_orderstatus = 'O' AND o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'no safe column' END AS skip_reason,
       CASE WHEN o_orderstatus = 'O' AND o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 THEN 'load failed' END AS error_message,
       CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 97 <> 0 THEN o_orderdate + INTERVAL '1' HOUR END AS ended_at
FROM {orders}"""

CLASSES = """
SELECT o_custkey AS source_table_id, 'c' || CAST(o_orderkey AS STRING) AS column_name,
       CASE WHEN o_orderpriority LIKE '1%' THEN 'sensitive'
            WHEN o_orderpriority LIKE '2%' THEN 'internal'
            WHEN o_orderpriority LIKE '3%' THEN 'brand-new-label'
            ELSE 'public' END AS classification,
       CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS secret_level
FROM {orders}"""

MARKS = """
SELECT c_custkey AS source_table_id, CAST(c_custkey * 10 AS STRING) AS mark
FROM {customer} WHERE c_custkey % 3 = 0"""

RELEASES = """
SELECT 'd' || CAST(o_custkey AS STRING) AS table_name, o_orderkey AS version,
       CASE WHEN o_orderstatus = 'F' THEN 'published' WHEN o_orderstatus = 'O' THEN 'requested' ELSE 'failed' END AS status,
       'u' || CAST(o_custkey % 50 AS STRING) AS requested_by, o_orderpriority AS title, o_orderdate AS requested_at,
       CAST(floor(o_totalprice) AS BIGINT) AS row_count
FROM {orders}"""

ACCOUNTS = """
SELECT lower(c_name) AS username,
       split_part('none,viewer,viewer_exec,steward,analyst,admin', ',', CAST(1 + c_custkey % 6 AS INT)) AS access_tier,
       CASE WHEN c_custkey % 2 = 1 THEN lower(c_mktsegment) END AS org_unit,
       c_custkey % 11 <> 0 AS is_active
FROM {customer}"""

UPLOADS = """
SELECT event_id AS upload_id, user_id, ts AS uploaded_at,
       split_part('report.csv,Scan 1.PDF,letter.docx,photo.png,notes.CSV,no_suffix', ',', CAST(1 + event_id % 6 AS INT)) AS filename,
       CAST(floor(value * 400000) AS BIGINT) AS size_bytes,
       CASE WHEN event_id % 13 = 0 THEN 'Bad Unit' ELSE event_type END AS org_unit,
       split_part('pending_review,loading,registered,rejected', ',', CAST(1 + event_id % 4 AS INT)) AS status
FROM {events}"""

# Actions on uploads: each user's events are the history of one upload.
ACTIONS = """
SELECT user_id AS upload_id, event_id,
       CASE event_type WHEN 'signup' THEN 'submit' WHEN 'view' THEN 'approve' WHEN 'click' THEN 'load_failed'
                       WHEN 'purchase' THEN 'loaded' ELSE 'reject' END AS action
FROM {events}"""

REQUESTS = """
SELECT event_id,
       CASE WHEN event_id % 29 = 0 THEN 'dashboard' ELSE 'user' || CAST(user_id AS STRING) END AS user_name,
       split_part('admin;ingestion;analyst;viewer,viewer_exec;viewer,viewer_org_eng;viewer;steward,steward_org_med;steward;publisher;maintenance;nobody',
                  ';', CAST(1 + event_id % 11 AS INT)) AS groups_text,
       split_part('SelectFromColumns,InsertIntoTable,CreateTable,ExecuteQuery,DropTable,CreateSchema,ExecuteTableProcedure,ImpersonateUser,SetCatalogSessionProperty,DeleteFromTable',
                  ',', CAST(1 + user_id % 10 AS INT)) AS operation,
       split_part('lake,staging,platform,other', ',', CAST(1 + CAST(floor(event_id / 11.0) AS BIGINT) % 4 AS INT)) AS catalog_name,
       split_part('raw,curated,published,documents,raw_staging,information_schema,ingest', ',', CAST(1 + CAST(floor(event_id / 44.0) AS BIGINT) % 7 AS INT)) AS schema_name,
       CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'view' THEN 'steward_eng_x' ELSE 't1' END AS table_name,
       CAST(event_id % 2 AS INT) AS n_columns,
       CASE WHEN event_id % 3 = 0 THEN 'expire_snapshots_min_retention' ELSE 'other' END AS property
FROM {events}"""
