"""Access rules as data: decisions for tables of requests, row filters, tiers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Members of ``group`` may do ``operations`` on the named catalogs, schemas and tables.

    An empty tuple means "any"; ``table`` rules never apply to requests without a table.
    """

    group: str
    operations: tuple[str, ...] = ()
    catalogs: tuple[str, ...] = ()
    schemas: tuple[str, ...] = ()
    table_prefix: str = ""
    needs_scope: str = ""
    only_without_columns: bool = False
    on_table: bool = True


# Operations every member needs to start a query and to list what exists.
CONTROL = (
    "ExecuteQuery",
    "AccessCatalog",
    "FilterCatalogs",
    "FilterSchemas",
    "FilterTables",
    "FilterColumns",
    "FilterFunctions",
    "ShowSchemas",
    "ShowTables",
    "ShowColumns",
    "ShowCreateSchema",
    "ShowCreateTable",
    "ShowFunctions",
    "ShowCreateFunction",
    "ExecuteFunction",
    "ReadSystemInformation",
    "ViewQueryOwnedBy",
    "FilterViewQueryOwnedBy",
)
READ = ("SelectFromColumns",)
LAKE, STAGING, PLATFORM = "lake", "staging", "platform"
META = "information_schema"
# Retention properties maintenance may set.
RETENTION_PROPERTIES = ("expire_snapshots_min_retention", "remove_orphan_files_min_retention")

# Who may do what. Anything no rule names is denied.
RULES = (
    Rule("admin", on_table=False),
    Rule("ingestion", (), (LAKE,), ("raw", "curated", "documents")),
    Rule("ingestion", (), (STAGING,), ("raw_staging",)),
    Rule("ingestion", READ, (LAKE, STAGING), (META,)),
    Rule("ingestion", CONTROL, on_table=False),
    Rule("ingestion", ("CreateSchema",), (LAKE, STAGING), on_table=False),
    Rule("analyst", READ, (LAKE,), ("curated", "published", META)),
    Rule(
        "analyst",
        ("InsertIntoTable", "UpdateTableColumns", "DeleteFromTable", "CreateTable", "DropTable"),
        (LAKE,),
        ("curated",),
    ),
    Rule("analyst", READ, (LAKE,), ("raw",), table_prefix="steward_"),
    Rule("analyst", READ, (PLATFORM,), ("ingest", META)),
    Rule("analyst", CONTROL, on_table=False),
    Rule("viewer", READ, (LAKE,), ("published",), needs_scope="viewer"),
    Rule("viewer", READ, (LAKE,), (META,)),
    Rule("viewer", CONTROL, on_table=False),
    Rule("steward", READ, (LAKE,), ("curated", "published"), needs_scope="steward"),
    Rule("steward", READ, (LAKE,), (META,)),
    Rule("steward", CONTROL, on_table=False),
    Rule("publisher", READ, (LAKE,), ("curated", "published", META)),
    Rule("publisher", ("CreateTable", "DropTable", "InsertIntoTable"), (LAKE,), ("published",)),
    Rule("publisher", CONTROL, on_table=False),
    Rule("maintenance", ("ExecuteTableProcedure", "AlterTableExecute"), (LAKE,), ("raw", "curated", "published")),
    Rule("maintenance", READ, (LAKE,), (META,)),
    Rule("maintenance", READ, (LAKE,), ("raw", "curated", "published"), only_without_columns=True),
    Rule("maintenance", ("InsertIntoTable", "DeleteFromTable"), (LAKE,), ("raw", "curated", "published")),
    Rule("maintenance", CONTROL, on_table=False),
)
IMPERSONATOR = "dashboard"


def units(groups: Column, role: str) -> Column:
    """Org units a role is scoped to: the tails of its ``<role>_org_<unit>`` groups."""
    prefix = f"{role}_org_"
    scoped = F.filter(groups, lambda g: F.startswith(g, F.lit(prefix)))
    return F.transform(scoped, lambda g: F.substring(g, F.lit(len(prefix) + 1), F.length(g)))


def _scoped(groups: Column, role: str) -> Column:
    has_units = F.exists(groups, lambda g: F.startswith(g, F.lit(f"{role}_org_")))
    return has_units | F.array_contains(groups, "viewer_exec") if role == "viewer" else has_units


def _applies(rule: Rule) -> Column:
    groups = F.col("groups")
    checks = [F.array_contains(groups, rule.group)]
    for column, wanted in (("operation", rule.operations), ("catalog", rule.catalogs), ("schema", rule.schemas)):
        if wanted:
            checks.append(F.col(column).isin(list(wanted)))
    if rule.on_table:
        checks.append(F.col("table").isNotNull())
    if rule.table_prefix:
        checks.append(F.startswith(F.col("table"), F.lit(rule.table_prefix)))
    if rule.needs_scope:
        checks.append(_scoped(groups, rule.needs_scope))
    if rule.only_without_columns:
        checks.append(F.coalesce(F.size("columns"), F.lit(0)) <= 0)
    verdict = checks[0]
    for check in checks[1:]:
        verdict = verdict & check
    return F.coalesce(verdict, F.lit(False))


def allowed(rules: Sequence[Rule] = RULES) -> Column:
    """Whether the request in this row is allowed, over columns user, groups, operation,
    catalog, schema, table, columns and property.

    The rules are a fixed short list, so the decision is one expression: no join, no shuffle.
    """
    verdict = (F.col("user") == IMPERSONATOR) & (F.col("operation") == "ImpersonateUser")
    verdict = verdict | (
        F.array_contains("groups", "maintenance")
        & (F.col("operation") == "SetCatalogSessionProperty")
        & (F.col("catalog") == LAKE)
        & F.col("property").isin(list(RETENTION_PROPERTIES))
    )
    verdict = F.coalesce(verdict, F.lit(False))
    for rule in rules:
        verdict = verdict | _applies(rule)
    return verdict


def decide(requests: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Requests with their ``allow`` decision; default deny."""
    return requests.withColumn("allow", allowed(rules))


def visible_units(groups: Sequence[str], schema: str) -> list[str] | None:
    """Org units a member's read of a scoped table is filtered to; None: no filter applies.

    The filters belong to the roles viewer (not executive) and steward, whatever other role is held besides.
    """
    held = set(groups)
    tails = lambda role: {g.removeprefix(f"{role}_org_") for g in groups if g.startswith(f"{role}_org_")}
    seen = set()
    if "viewer" in held and "viewer_exec" not in held and schema == "published":
        seen |= tails("viewer")
    if "steward" in held and schema in ("curated", "published"):
        seen |= tails("steward")
    return sorted(seen) or None


REQUEST = "user string, groups array<string>, operation string, catalog string, schema string, table string, columns array<string>, property string"


def secured(df: DataFrame, table: str, schema: str, groups: Sequence[str], scoped_tables: Sequence[str]) -> DataFrame:
    """The table as this member may read it.

    The rules decide first, and a read they deny is refused. Then scoped tables
    show the rows of any of the member's units. The filter is an ordinary predicate and reaches the scan.
    """
    asked = [(None, list(groups), "SelectFromColumns", LAKE, schema, table, list(df.columns), None)]
    if not decide(df.sparkSession.createDataFrame(asked, REQUEST)).first().allow:
        raise PermissionError(f"no right to read {schema}.{table}")
    mine = visible_units(groups, schema)
    return df if mine is None or table not in scoped_tables else df.filter(F.col("org_unit").isin(mine))


def secured_for_all(df: DataFrame, grants: DataFrame) -> DataFrame:
    """Rows each member sees: (username, org_unit) grants joined to the rows of the unit."""
    return df.join(grants.select("username", "org_unit").distinct(), "org_unit")


# Tiers in use and the groups they carry.
TIER_GROUPS = {"viewer": ["viewer", "viewer_exec"], "analyst": ["analyst"], "admin": ["admin"]}


def tier_groups(accounts: DataFrame) -> DataFrame:
    """(username, access_tier, groups) of active accounts that were granted a tier."""
    groups = F.lit(None).cast("array<string>")
    for tier, names in TIER_GROUPS.items():
        groups = F.when(F.col("access_tier") == tier, F.array(*map(F.lit, names))).otherwise(groups)
    granted = accounts.filter(F.col("is_active") & (F.col("access_tier") != "none"))
    return granted.select("username", "access_tier", groups.alias("groups"))


def migrate_tiers(accounts: DataFrame, reason: str = "three_tiers") -> tuple[DataFrame, DataFrame]:
    """(accounts on the tiers in use, one audit row with before and after per changed account)."""
    old = F.col("access_tier").isin("viewer_exec", "steward") | (
        (F.col("access_tier") == "viewer") & F.col("org_unit").isNotNull()
    )
    old = F.coalesce(old, F.lit(False))
    moved = accounts.select(
        *[
            F.when(old, F.lit(v).cast(t)).otherwise(F.col(c)).alias(c)
            if (v := {"access_tier": "viewer", "org_unit": None}.get(c, ...)) is not ...
            else F.col(c)
            for c, t in accounts.dtypes
        ]
    )
    state = lambda tier, unit: F.struct(tier.alias("access_tier"), unit.alias("org_unit"), "is_active")
    detail = F.struct(
        F.lit(reason).alias("reason"),
        state(F.col("access_tier"), F.col("org_unit")).alias("before"),
        state(F.lit("viewer"), F.lit(None).cast("string")).alias("after"),
    )
    audit = accounts.filter(old).select(
        "username", F.lit("account_updated").alias("action"), F.to_json(detail, {"ignoreNullFields": "false"}).alias("detail")
    )
    return moved, audit


def revert_tiers(accounts: DataFrame, audit: DataFrame, reason: str = "three_tiers") -> DataFrame:
    """Tiers as they were before a migration, read back from its audit rows (one per account)."""
    detail = F.col("detail")
    before = audit.filter(F.get_json_object(detail, "$.reason") == reason).select(
        "username",
        F.get_json_object(detail, "$.before.access_tier").alias("_tier"),
        F.get_json_object(detail, "$.before.org_unit").alias("_unit"),
    )
    undo = (F.col("access_tier") == "viewer") & F.col("_tier").isNotNull()
    joined = accounts.join(before, "username", "left")
    return joined.select(
        *[
            F.when(undo, F.col("_tier")).otherwise(F.col(c)).alias(c)
            if c == "access_tier"
            else F.when(undo, F.col("_unit")).otherwise(F.col(c)).alias(c)
            if c == "org_unit"
            else F.col(c)
            for c in accounts.columns
        ]
    )
