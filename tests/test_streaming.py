import random

from datetime import datetime

import pandas as pd
from pyspark.sql import functions as F

from loamlake.runtime import scratch_dir
from loamlake.sinks import tables as K
from loamlake.streaming import jobs, stateful


def brute_limiter(attempts, limit, window):
    state, out = {}, {}
    for key, i, ts, failed in attempts:
        count, start = state.get(key, (0, None))
        if start is not None and ts - start > window:
            count, start = 0, None
        if count >= limit:
            out[i] = False
        else:
            out[i] = True
            if failed:
                count, start = count + 1, start if start is not None else ts
            else:
                count, start = 0, None
        state[key] = (count, start)
    return out


def test_limiter_over_several_batches(spark):
    rng = random.Random(6)
    attempts, clock = [], 1_700_000_000
    for i in range(900):
        clock += rng.choice([1, 5, 20, 120])
        attempts.append((rng.choice(["hot", "hot", "a", "b"]), i, clock, rng.random() < 0.8))
    folder, out, checkpoint = (scratch_dir(spark, n) for n in ("attempts", "out", "checkpoint"))
    schema = "key string, event_id bigint, ts timestamp, failed boolean"
    for part in range(3):
        rows = [(k, i, datetime.fromtimestamp(t), f) for k, i, t, f in attempts[part * 300 : part * 300 + 300]]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        jobs.append_new_files(stateful.limit_failures(stream, max_failures=3, window_seconds=300), out, checkpoint).awaitTermination()
    got = {r.event_id: r.allowed for r in spark.read.parquet(out).collect()}
    assert got == brute_limiter(attempts, 3, 300)


def test_first_copies_whatever_the_order_of_arrival(spark):
    """The least time wins although it comes last; a copy behind the watermark is dropped; a forgotten key may come again."""
    folder, out, checkpoint = (scratch_dir(spark, n) for n in ("docs", "out", "checkpoint"))
    at = lambda s: datetime.fromtimestamp(1_700_000_000 + s)
    batches = [[(5, "a  b", at(50)), (9, "c", at(90))], [(1, "A B", at(10)), (7, "c", at(90))], [(100, "x", at(1000))], [(103, "z", at(1001))], [(2, "a b", at(5)), (101, "C", at(1010))], [(102, "y", at(9000))]]
    schema = "doc_id bigint, text string, ts timestamp"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    jobs.append_new_files(stateful.first_copies(stream, late="100 seconds", forget_seconds=600), out, checkpoint).awaitTermination()
    assert sorted(r.place for r in spark.read.parquet(out).collect()) == [1, 7, 100, 101, 103]


def test_watch_reads_new_files_once(spark, tmp_path):
    folder, root, checkpoint = str(tmp_path), scratch_dir(spark, "raw"), scratch_dir(spark, "checkpoint")
    declared = {"extract_a": {"n": "int", "s": "string"}}

    def turn(at):
        for q in jobs.watch_extracts(spark, folder, declared, root, checkpoint, at):
            q.awaitTermination()

    (tmp_path / "extract_a.csv").write_text("n,s\n1,x\n2,\n")
    (tmp_path / "other.csv").write_text("n,s\n9,z\n")
    turn("2024-01-01T00:00:00")
    turn("2024-01-02T00:00:00")
    assert K.log(spark, f"{root}/extract_a").count() == 1
    (tmp_path / "extract_a-2.csv").write_text("n,s\n3,y\n")
    turn("2024-01-03T00:00:00")
    got = K.read_table(spark, f"{root}/extract_a").collect()
    assert [(r.n, r.s, r._source_table) for r in got] == [(3, "y", "extract_a")]


def test_dedup_stream_remembers_across_runs(spark):
    folder, out, checkpoint = (scratch_dir(spark, n) for n in ("docs", "out", "checkpoint"))
    for texts in (["a b", "c"], ["A  B", "d", "c "]):
        spark.createDataFrame([(t,) for t in texts], "text string").write.mode("append").parquet(folder)
        stream = spark.readStream.schema("text string").parquet(folder)
        jobs.append_new_files(jobs.dedup_stream(stream), out, checkpoint).awaitTermination()
    assert sorted(r.text.strip().lower() for r in spark.read.parquet(out).collect()) == ["a b", "c", "d"]


def test_bounded_dedup_stream(spark):
    stream = spark.readStream.format("rate").load().select(F.col("timestamp").alias("ts"), F.lit("x").alias("text"))
    assert jobs.dedup_stream(stream, ts="ts").isStreaming


class Store:
    """Counts the calls of a state processor, which cost far more than rows."""

    def __init__(self):
        self.calls, self.value, self.timers = 0, None, set()

    def getValueState(self, *_):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def exists(self):
        self.calls += 1
        return self.value is not None

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


class Clock:
    def __init__(self, now):
        self.getCurrentProcessingTimeInMs = self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: now


def test_states_of_many_keys_cost_few_calls():
    """A thousand keys of a group are one value of the store; with a time to forget, a key in time is dropped, a later one comes again."""
    store, first = Store(), stateful.KeepFirst(1000)
    first.init(store)
    keys = [f"{i:032x}" for i in range(1000)]
    rows = lambda at, place: pd.DataFrame({"key": keys, "at_us": at, "place": place})
    assert not list(first.handleInputRows((0,), iter([rows(5_000_000, 9), rows(4_000_000, 7), rows(4_000_000, 8)]), Clock(0)))
    (given,) = first.handleExpiredTimer((0,), Clock(4001), Clock(min(store.timers)))
    assert sorted(given["key"]) == keys and set(given["place"]) == {7} and store.calls < 12
    store.timers.discard(4001)
    list(first.handleInputRows((0,), iter([rows(4_900_000, 1), rows(5_600_000, 3), rows(4_999_000, 2)]), Clock(4001)))
    (given,) = first.handleExpiredTimer((0,), Clock(5601), Clock(min(store.timers)))
    assert set(given["place"]) == {3}
    store.timers.discard(5601)
    assert not list(first.handleExpiredTimer((0,), Clock(9000), Clock(min(store.timers)))) and store.value is None

    store, limiter = Store(), stateful.Limiter(1, 1_000_000, True)
    limiter.init(store)
    tries = pd.DataFrame({"key": keys, "at_us": 0, "event_id": range(1000), "failed": True})
    decided = [next(iter(limiter.handleInputRows((0,), iter([tries]), Clock(at))))["allowed"].all() for at in (0, 500, 1500)]
    assert decided == [True, False, True] and store.calls <= 6
