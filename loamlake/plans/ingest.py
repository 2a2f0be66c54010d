"""Registry-driven loads: decide, project safe columns, cast, write with audit columns, log the run."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamlake.functions.types import spark_type, split_castable, typed
from loamlake.operators.guard import host_refusal
from loamlake.operators.registry import load_decisions, safe_by_table
from loamlake.runtime import path_exists
from loamlake.sinks.folders import append_run, put_if_absent, read_small, refresh, remove, rename, run_rows
from loamlake.sinks.tables import DAY, with_audit
from loamlake.sources.tables import newer_than, next_mark

RUNS = (
    "table_name string, run_id string, status string, skip_reason string, error_message string, "
    "rows_written bigint, columns_selected bigint, columns_excluded bigint, mark string"
)


ERROR_CHARS = 500


@dataclass
class Job:
    """Where a registry-driven load reads and writes."""

    root: str
    source_key: str
    read: Callable[[str, Sequence[str]], DataFrame]
    at: str
    denied: Sequence[str] = ()
    allowed: Sequence[str] = ()
    marks: Mapping[str, str] = field(default_factory=dict)
    log: str | None = None
    now: Callable[[], float] = time.time
    max_age_seconds: int = 6 * 3600

    def target(self, table: str) -> str:
        return f"{self.root}/raw/{table.split('.')[-1]}"


def load_all(spark: SparkSession, job: Job, tables: DataFrame, registry: DataFrame) -> DataFrame:
    """Load every registered table; one run row each. A failing table does not stop the others.

    The loop is over registered tables; their rows never leave the executors.
    With ``log`` each run's row is appended to that folder when it starts and
    when it ends, and a table is claimed by a marker that only one run can put; the mark is read
    after that. A claim older than ``max_age_seconds`` is of a run that was killed: that run is closed first,
    see :func:`close_abandoned`.
    """
    safe = safe_by_table(registry)
    allowed = host_refusal(F.col("host"), job.denied, job.allowed).isNull()
    decisions = {r.table_name: r for r in load_decisions(tables, registry, allowed).collect()}
    runs = []
    for table in sorted(tables.collect(), key=lambda t: t.table_name):
        decision = decisions[table.table_name]
        run_id = f"run-{uuid.uuid4().hex}"
        counts = (decision.columns_selected, decision.columns_excluded)
        if decision.decision == "skipped":
            runs.append((table.table_name, run_id, "skipped", decision.skip_reason, None, None, *counts, None))
            continue
        if job.log and not claim(spark, job, table, run_id):
            runs.append((table.table_name, run_id, "skipped", "another run of this table is open", None, None, *counts, None))
            continue
        mark = job.marks.get(table.table_name) or (last_mark(spark, job.log, table.table_name) if job.log else None)
        note(spark, job, (table.table_name, run_id, "running", None, None, None, *counts, mark))
        try:
            rows, mark = load_one(job, table, safe.get(table.table_name, []), run_id, mark)
            runs.append((table.table_name, run_id, "succeeded", None, None, rows, *counts, mark))
        except Exception as error:  # noqa: BLE001 - recorded in the run log
            reason = f"{type(error).__name__}: {error}".split("\n")[0][:ERROR_CHARS]
            runs.append((table.table_name, run_id, "failed", None, reason, None, *counts, mark))
        note(spark, job, runs[-1])
        if job.log:
            remove(spark, claim_path(job, table.table_name))
    return spark.createDataFrame(runs, RUNS)


def note(spark: SparkSession, job: Job, row: tuple) -> None:
    """Append a run's row to the log."""
    if job.log:
        spark.createDataFrame([(*row, time.time_ns())], f"{RUNS}, noted bigint").coalesce(1).write.mode("append").parquet(job.log)


def claim_path(job: Job, table: str) -> str:
    return f"{job.log}/_claims/{table}"


def claim(spark: SparkSession, job: Job, table, run_id: str) -> bool:
    """Put the table's marker; a marker that is too old is taken away first, which again only one caller can do."""
    path = claim_path(job, table.table_name)
    held = read_small(spark, path)
    if held:
        holder, since = held.split()
        if job.now() - float(since) < job.max_age_seconds or not rename(spark, path, f"{path}.{holder}"):
            return False
        close_abandoned(spark, job, table, holder)
        remove(spark, f"{path}.{holder}")
    return put_if_absent(spark, path, f"{run_id} {job.now()}")


def close_abandoned(spark: SparkSession, job: Job, table, run_id: str) -> None:
    """Close the log of a run that was killed. Rows it had committed stay and give the mark, so the next run does not load them again."""
    rows = mark = None
    committed = run_rows(spark, job.target(table.table_name), run_id) if table.load_mode == "incremental" else None
    if committed is None:
        why = f"abandoned: still in progress after {job.max_age_seconds // 3600} hours"
        note(spark, job, (table.table_name, run_id, "failed", None, why, None, None, None, last_mark(spark, job.log, table.table_name)))
        return
    rows, mark = committed.agg(F.count("*"), F.max(table.incremental_column).cast("string")).first()
    note(spark, job, (table.table_name, run_id, "succeeded", None, "closed after it was abandoned", rows, None, None, mark))


def last_mark(spark: SparkSession, log: str, table: str) -> str | None:
    """The mark of the newest row of a table in the run log."""
    if not path_exists(spark, log):
        return None
    rows = spark.read.schema(f"{RUNS}, noted bigint").parquet(log).filter(F.col("table_name") == table)
    return rows.agg(F.max_by("mark", "noted")).first()[0]


def load_one(job: Job, table, names: Sequence[str], run_id: str, old_mark: str | None = None) -> tuple[int, str | None]:
    """Load one table's safe columns; (rows written, new mark).

    An incremental load takes what lies above the old mark and not above the new one, so rows that
    arrive between the two reads are left to the next run.
    """
    df = job.read(table.table_name, names).select(*names)
    incremental = table.load_mode == "incremental"
    if incremental:
        df = newer_than(df, table.incremental_column, old_mark)
        mark = next_mark(df, table.incremental_column).first().mark
        if mark is None:
            return 0, old_mark  # nothing new: the mark stays where it is
        df = df.filter(F.col(table.incremental_column) <= F.lit(mark).cast(df.schema[table.incremental_column].dataType))
    audited = with_audit(df, job.at, source_system=job.source_key, source_table=table.table_name, run_id=run_id)
    target = job.target(table.table_name)
    if incremental:
        return append_run(audited, target, run_id, (DAY,)), mark
    return refresh(audited, target, (DAY,)), None


def load_staged(
    staged: DataFrame, declared: Mapping[str, str], target: str, *, source_key: str, source_table: str, at: str, append: bool = False
) -> int:
    """Load a staged CSV table under declared source types; a bad value fails the whole load."""
    run_id = f"run-{uuid.uuid4().hex}"
    df = typed(staged, {name: spark_type(kind) for name, kind in declared.items()})
    audited = with_audit(df, at, source_system=source_key, source_table=source_table, run_id=run_id)
    return append_run(audited, target, run_id, (DAY,)) if append else refresh(audited, target, (DAY,))


def load_routed(staged: DataFrame, types: Mapping[str, str], target: str, rejected: str) -> tuple[int, int]:
    """Load what casts; rows that do not are kept in ``rejected`` with the failing columns, never dropped."""
    good, bad = split_castable(staged, types)
    return refresh(good, target), refresh(bad, rejected)
