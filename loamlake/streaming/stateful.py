"""Keyed state on streams: the first of all copies by event time, and the failure limiter.

Both are state processors. A call of Python and of the engine's key-value store costs far more than a row,
so keys are dealt over groups by their hash: the state of a group's keys is one value of the store, its rows
come in bounded frames, and timers or a time to live forget keys. A batch reads and writes the state of the groups
it touches, so there should be a group for every few thousand keys that are remembered.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loamlake.functions.text import dedup_key

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DECISIONS = "key string, event_id bigint, ts timestamp, failed boolean, allowed boolean, retry_after bigint"
MICRO = 1_000_000
FOR_EVER = (1 << 62) // 1000


def _with_store(stream: DataFrame) -> DataFrame:
    """State processors need the store with several kinds of state."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return stream


def in_groups(stream: DataFrame, groups: int) -> DataFrame:
    """Adds ``_group``, a part of the keys by their hash."""
    return stream.withColumn("_group", F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int"))


KNOWN = {"key": "S32", "at_us": np.int64, "place": np.int64, "until_ms": np.int64}
NEVER = np.iinfo(np.int64).min


class KeepFirst(StatefulProcessor):
    """Holds the least (event time, place) of every key of a group until no earlier one can come, then gives it out once.

    Per key: the least copy until it is given out (NEVER: none is held), and the time until which copies are dropped (NEVER: none was given out).
    """

    def __init__(self, forget_ms: int | None):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("known", ", ".join(f"{c} binary" for c in KNOWN) + ", timer_ms long")

    def _read(self) -> tuple[pd.DataFrame, int | None]:
        *held, timer = self.state.get() or (*[b""] * len(KNOWN), None)
        columns = {c: np.frombuffer(h, t) for (c, t), h in zip(KNOWN.items(), held)}
        return pd.DataFrame(columns | {"key": columns["key"].astype(object)}), timer

    def _write(self, known: pd.DataFrame, timer: int | None) -> None:
        """Store what is known; one timer a group, at the next time at which a key is given out or forgotten."""
        due = np.where(known["at_us"] == NEVER, known["until_ms"], known["at_us"] // 1000) + 1
        due = due[due <= FOR_EVER]
        wanted = int(due.min()) if len(due) else None
        if wanted != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        if len(known):
            self.state.update((*[known[c].to_numpy().astype(t).tobytes() for c, t in KNOWN.items()], wanted))
        else:
            self.state.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, timer = self._read()
        for frame in rows:
            new = frame[["key", "at_us", "place"]].assign(key=frame["key"].to_numpy().astype("S32").astype(object))
            until = known.set_index("key")["until_ms"]
            new = new[~(until.reindex(new["key"]).to_numpy() > new["at_us"].to_numpy() // 1000)]
            held = known.loc[known["at_us"] != NEVER, ["key", "at_us", "place"]]
            least = pd.concat([held, new], ignore_index=True).sort_values(["at_us", "place"], kind="stable").drop_duplicates("key")
            least["until_ms"] = until.reindex(least["key"], fill_value=NEVER).to_numpy()
            known = pd.concat([known[~known["key"].isin(least["key"])], least], ignore_index=True)
        self._write(known, timer)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known, timer = self._read()
        now = expiredTimerInfo.getExpiryTimeInMs()
        if timer != now:
            return
        now = max(now, timerValues.getCurrentWatermarkInMs())
        at, until = known["at_us"].to_numpy(), known["until_ms"].to_numpy()
        out = (at != NEVER) & (at // 1000 < now)
        given = known[out]
        until = np.where(out, FOR_EVER if self.forget_ms is None else at // 1000 + (self.forget_ms or 0), until)
        known = known.assign(at_us=np.where(out, NEVER, at), until_ms=until)
        self._write(known[(known["at_us"] != NEVER) | (until >= now)], None)
        if len(given):
            yield pd.DataFrame({"key": given["key"].str.decode("ascii"), "place": given["place"], "ts": pd.to_datetime(given["at_us"], unit="us")})

    def close(self) -> None:
        pass


def first_copies(stream: DataFrame, text: str = "text", *, place: str = "doc_id", ts: str = "ts", late: str = "1 day", forget_seconds: int | None = None, groups: int = 256) -> DataFrame:
    """key, place, ts of the first copy of every text: the least (``ts``, ``place``), whatever the order of arrival.

    A copy is given out when the watermark, ``late`` behind the newest ``ts``, has passed it: an earlier one would be dropped as late.
    Only time and place are kept per key, never a text; texts that are null are copies of each other, with an empty key, and a null place is the least. With ``forget_seconds`` a key is forgotten that long after its first
    copy by event time, once that was given out; without, it is remembered for ever. ``groups`` must stay what it was over the life of a checkpoint.
    """
    thin = stream.select(F.coalesce(dedup_key(F.col(text)), F.lit("")).alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.coalesce(F.col(place).cast("bigint"), F.lit(-(1 << 63))).alias("place"))
    timed = thin.withWatermark("ts", late).withColumn("at_us", F.unix_micros("ts"))
    made = T.StructType.fromDDL("key string, place bigint, ts timestamp")
    forget_ms = None if forget_seconds is None else 1000 * forget_seconds
    return _with_store(in_groups(timed, groups)).groupBy("_group").transformWithStateInPandas(KeepFirst(forget_ms), made, "Append", "EventTime")


def decide(at: np.ndarray, failed: np.ndarray, count: int, opened: int | None, most: int, window: int) -> tuple[np.ndarray, np.ndarray, int, int | None]:
    """(allowed, microseconds to wait) of one key's attempts in time order, and the state after them.

    The window opens at the first failure and stays fixed. At ``most``
    failures further attempts are refused until it has passed; a refused attempt counts
    as nothing, an allowed success forgets the failures. Refused attempts are passed over by a search.
    """
    allowed, wait = np.ones(len(at), bool), np.zeros(len(at), np.int64)
    i = 0
    while i < len(at):
        if opened is not None and at[i] - opened > window:
            count, opened = 0, None
        if count >= most:
            end = i + int(np.searchsorted(at[i:], opened + window, "right"))
            allowed[i:end], wait[i:end] = False, opened + window - at[i:end]
            i = end
            continue
        if not failed[i]:
            count, opened = 0, None
        else:
            count, opened = count + 1, int(at[i]) if opened is None else opened
        i += 1
    return allowed, wait, count, opened


class Limiter(StatefulProcessor):
    """Failures of the keys of a group and when their windows opened; nothing is kept of keys without failures."""

    def __init__(self, most: int, window: int, ttl: bool):
        self.most, self.window, self.ttl = most, window, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("failures", "known binary", self.window // 1000 if self.ttl else None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs() if self.ttl else 0
        # Per key: failures, when the window opened, when that was put down.
        held = self.state.get()
        known = pickle.loads(held[0]) if held else {}
        if self.ttl:
            known = {k: v for k, v in known.items() if now - v[2] < self.window // 1000}
        # Four values an attempt are held, to put a batch in order of time.
        attempts = pd.concat([f[["key", "at_us", "event_id", "failed"]] for f in rows], ignore_index=True)
        attempts["_of"], names = pd.factorize(attempts["key"], use_na_sentinel=False)
        attempts = attempts.sort_values(["_of", "at_us", "event_id"], kind="stable")
        at, failed = attempts["at_us"].to_numpy(np.int64), attempts["failed"].to_numpy(bool)
        ends = np.cumsum(np.bincount(attempts["_of"], minlength=len(names))).tolist()
        allowed, wait = np.ones(len(at), bool), np.zeros(len(at), np.int64)
        for name, begin, end in zip(names, [0, *ends], ends):
            name = None if pd.isna(name) else name
            count, opened, _ = known.get(name, (0, None, 0))
            allowed[begin:end], wait[begin:end], count, after = decide(at[begin:end], failed[begin:end], count, opened, self.most, self.window)
            if after is not None:
                known[name] = (count, after, now)
            else:
                known.pop(name, None)
        if known:
            self.state.update((pickle.dumps(known),))
        elif held:
            self.state.clear()
        retry = np.where(allowed, 0, np.maximum(1, -(-wait // MICRO)))
        yield pd.DataFrame({"key": attempts["key"].to_numpy(), "event_id": attempts["event_id"].to_numpy(), "ts": pd.to_datetime(at, unit="us"), "failed": failed, "allowed": allowed, "retry_after": retry})

    def close(self) -> None:
        pass


def limit_failures(stream: DataFrame, *, max_failures: int = 5, window_seconds: int = 900, sweep: bool = False, groups: int = 256) -> DataFrame:
    """Decision per attempt of a stream (key, event_id, ts, failed).

    Every attempt is decided, late ones too: no watermark drops any. A key's attempts of one batch are decided in order of
    time, batch after batch. ``sweep`` forgets a key as long as the window after its last failure by the clock; it is for live streams,
    as a replay may bring an attempt of the same window later than that. ``groups`` must stay what it was over the life of a checkpoint.
    """
    thin = stream.select("key", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), "failed")
    processor = Limiter(max_failures, window_seconds * MICRO, sweep)
    return _with_store(in_groups(thin, groups)).groupBy("_group").transformWithStateInPandas(processor, T.StructType.fromDDL(DECISIONS), "Append", "ProcessingTime" if sweep else "None")
