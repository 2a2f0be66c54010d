"""State machines kept as append-only events: runs, uploads, releases; reaper and retention."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamlake.operators.running import running_sum
from loamlake.runtime import cut_lineage

# Fixed values: (state, action) -> next state.
RUN = {
    ("new", "claim"): "running",
    ("running", "skip"): "skipped",
    ("running", "fail"): "failed",
    ("running", "succeed"): "succeeded",
}
UPLOAD = {
    ("new", "submit"): "pending_review",
    ("pending_review", "approve"): "loading",
    ("loading", "loaded"): "registered",
    ("loading", "load_failed"): "pending_review",
    ("loading", "interrupted"): "pending_review",
    ("pending_review", "register"): "registered",
    ("pending_review", "reject"): "rejected",
}
RELEASE = {
    ("new", "request"): "requested",
    ("requested", "approve"): "approved",
    ("requested", "reject"): "rejected",
    ("approved", "publish"): "published",
    ("approved", "fail"): "failed",
    ("approved", "interrupted"): "failed",
}


def decision(action: Column, actor: Column, requested_by: Column) -> Column:
    """The action as the release machine knows it: requesters may approve but not reject their own request."""
    return F.when((action == "reject") & (actor == requested_by), "reject_own").otherwise(action)


def states(machine: Mapping[tuple[str, str], str]) -> list[str]:
    return sorted({s for pair, s in machine.items() for s in (pair[0], s)})


def replay(events: DataFrame, machine: Mapping[tuple[str, str], str], keys: Sequence[str], order: Sequence[str], code: Column | None = None) -> DataFrame:
    """Final ``status`` per key after all its actions in order, with applied and refused counts.

    ``code`` is what an event leaves as ``code`` when it is applied: null keeps the one before, an empty one clears it.

    An action without a transition from the current state is refused and
    changes nothing. Every action is a function from state to state; functions
    of neighbouring events are composed, so nothing depends on one key's
    events meeting in one task in order: see :func:`compose`.
    """
    composed = compose(events, machine, keys, order, code=code)
    start = states(machine).index("new")
    names = F.array(*map(F.lit, states(machine)))
    end = F.element_at("step", start + 1)
    return composed.select(
        *keys,
        F.element_at(names, (end["state"] + 1).cast("int")).alias("status"),
        end["applied"].alias("applied"),
        (F.col("events") - end["applied"]).alias("refused"),
        *([] if code is None else [F.nullif(end["code"], F.lit("")).alias("code")]),
    )


def compose(
    events: DataFrame, machine: Mapping[tuple[str, str], str], keys: Sequence[str], order: Sequence[str], chunk: int = 500, code: Column | None = None
) -> DataFrame:
    """(keys, step, events): ``step[s]`` is the state reached, the actions applied from state ``s`` and the code they leave.

    Long histories are cut into chunks of ``chunk`` consecutive events, composed
    chunk by chunk in parallel, and the chunks composed again until one is left.
    """
    known = states(machine)
    actions = sorted({action for _, action in machine})
    table = F.create_map(
        *[
            x
            for action in actions
            for x in (
                F.lit(action),
                F.array(
                    *[
                        F.struct(
                            F.lit(known.index(machine.get((s, action), s))).alias("state"),
                            F.lit(int((s, action) in machine)).cast("bigint").alias("applied"),
                        )
                        for s in known
                    ]
                ),
            )
        ]
    )
    stay = F.array(*[F.struct(F.lit(i).alias("state"), F.lit(0).cast("bigint").alias("applied")) for i in range(len(known))])
    sizes = events.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    step = F.coalesce(F.try_element_at(table, F.col("action")), stay)
    left = F.lit(None).cast("string") if code is None else code
    step = F.transform(step, lambda x: F.struct(x["state"], x["applied"], F.when(x["applied"] == 1, left).alias("code")))
    # Events with equal order follow each other by what they do, so both paths below agree.
    current = events.select(*keys, *order, F.coalesce("action", F.lit("")).alias("_tie"), step.alias("step"), F.lit(1).cast("bigint").alias("events"))
    order = [*order, "_tie"]
    while sizes > chunk:
        # A number per row carries it through the running sum: keys may be NULL and orders equal.
        current = cut_lineage(current.withColumn("_row", F.monotonically_increasing_id()))
        place = running_sum(current, F.lit(1), [*order, "_row"], keys)
        placed = current.join(place.select("_row", F.floor(F.col("before") / chunk).alias("_place")), "_row")
        current = _fold(placed.groupBy(*keys, "_place"), [*order, "_row"]).select(*keys, F.col("_place").alias("place"), "step", "events")
        order, sizes = ["place"], -(-sizes // chunk)
    return _fold(current.groupBy(*keys), order)


def _fold(grouped, order: Sequence[str]) -> DataFrame:
    """Compose the steps of each (bounded) group in order."""
    listed = grouped.agg(F.array_sort(F.collect_list(F.struct(*order, "step"))).alias("steps"), F.sum("events").alias("events"))
    first = F.col("steps")[0]["step"]
    rest = F.slice("steps", F.lit(2), F.size("steps"))

    def then(done: Column, nxt: Column) -> Column:
        return F.transform(
            done,
            lambda d: F.struct(
                F.element_at(nxt["step"], (d["state"] + 1).cast("int"))["state"].alias("state"),
                (d["applied"] + F.element_at(nxt["step"], (d["state"] + 1).cast("int"))["applied"]).alias("applied"),
                F.coalesce(F.element_at(nxt["step"], (d["state"] + 1).cast("int"))["code"], d["code"]).alias("code"),
            ),
        )

    return listed.withColumn("step", F.aggregate(rest, first, then)).drop("steps")


def claimable(tables: DataFrame, runs: DataFrame) -> DataFrame:
    """Tables without a running run: those a new run may claim."""
    running = runs.filter(F.col("status") == "running").select("source_table_id").distinct()
    return tables.join(running, "source_table_id", "left_anti")


def close_stale(runs: DataFrame, as_of: Column, max_age: str = "6 hours") -> DataFrame:
    """Runs with those in progress for longer than ``max_age`` failed, ended and explained."""
    stale = (F.col("status") == "running") & (F.col("started_at") < as_of - F.expr(f"INTERVAL {max_age}"))
    return runs.withColumns(
        {
            "status": F.when(stale, "failed").otherwise(F.col("status")),
            "ended_at": F.when(stale, as_of).otherwise(F.col("ended_at")),
            "error_message": F.when(stale, f"abandoned: still in progress after {max_age}").otherwise(F.col("error_message")),
        }
    )


def interrupted(rows: DataFrame, open_state: str, back_to: str, code: str, code_column: str) -> DataFrame:
    """Rows a restart left in ``open_state``, moved on with a failure code."""
    cut = F.col("status") == open_state
    return rows.withColumns(
        {
            "status": F.when(cut, back_to).otherwise(F.col("status")),
            code_column: F.when(cut, code).otherwise(F.col(code_column)),
        }
    )


def purge(df: DataFrame, ts: str, as_of: Column, keep: str | None = None) -> DataFrame:
    """What retention keeps: nothing older than ``keep`` before ``as_of``; without ``keep``, nothing expired."""
    limit = as_of - F.expr(f"INTERVAL {keep}") if keep else as_of
    return df.filter(~F.coalesce(F.col(ts) < limit, F.lit(False)))


def purge_report(tables: Mapping[str, tuple[DataFrame, str, str | None]], as_of: Column) -> DataFrame:
    """(name, removed) for each {name: (table, time column, retention)}."""
    out = None
    for name, (df, ts, keep) in tables.items():
        limit = as_of - F.expr(f"INTERVAL {keep}") if keep else as_of
        one = df.agg(F.count_if(F.col(ts) < limit).alias("removed")).select(F.lit(name).alias("name"), "removed")
        out = one if out is None else out.unionByName(one)
    return out


def maintenance_targets(tables: DataFrame, systems: DataFrame, runs: DataFrame) -> DataFrame:
    """Enabled tables of enabled systems that were loaded with rows at least once."""
    loaded = runs.filter((F.col("status") == "succeeded") & (F.col("rows_written") > 0)).select("source_table_id")
    return (
        tables.filter("is_enabled")
        .join(systems.filter("system_enabled"), "source_system_id", "left_semi")
        .join(loaded.distinct(), "source_table_id", "left_semi")
    )


def maintenance_plan(targets: DataFrame, *, orphans: bool = False, min_retention: str | None = None) -> DataFrame:
    """One row per action: compaction where enabled, version expiry, orphan removal on request."""
    days = lambda c: F.lit(min_retention) if min_retention else F.concat(F.col(c).cast("string"), F.lit("d"))
    none = F.lit(None).cast("string")
    steps = [
        F.when(
            F.col("optimize_enabled"), F.struct(F.lit("optimize").alias("action"), none.alias("retention"))
        ),
        F.struct(F.lit("expire_snapshots").alias("action"), days("expire_snapshots_days").alias("retention")),
    ]
    if orphans:
        steps.append(F.struct(F.lit("remove_orphan_files").alias("action"), days("orphan_retention_days").alias("retention")))
    return targets.select("target_table", F.explode(F.array_compact(F.array(*steps))).alias("s")).select("target_table", "s.*")
