"""Streams that take the rows of a key in the order of time, with keyed state and timers.

Keys are dealt to buckets by a hash, and state is that of a bucket: a call of the state store takes a round trip, so one
entry holds rows of many keys. Rows wait in state, in entries for each slot of time, and are taken when the watermark has
passed the slot's end: so results do not depend on the order of arrival or on micro-batches. A task holds an Arrow batch
or the rows of one slot of one bucket, never all rows of a key. The state needs a store with column families, so the
session's streams use RocksDB.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Parts that the keys of a stream are dealt to; fixed for as long as its checkpoint lives.
BUCKETS = 256


def keyed_state(spark: SparkSession) -> None:
    """Streams that start in this session from here on keep their state in RocksDB; such as go on keep what they have."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class InOrder(StatefulProcessor):
    """Base: `take` gets the rows of a slot by `columns`, slot after slot; `expire` is called when nothing came since.

    Input has `at` (microseconds) and `columns` with their types. `expire` comes `linger` seconds past each slot with
    rows, rounded up to slots, after what lay in the slots until then was taken.
    """

    columns = {"at": "bigint", "seq": "bigint"}

    def __init__(self, slot: int, linger: int) -> None:
        self.slot = slot
        self.linger = -(-linger // slot)

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slot bigint, part bigint", ", ".join(f"{c} array<{t}>" for c, t in self.columns.items()))
        self.parts = handle.getMapState("parts", "slot bigint", "parts bigint")
        self.begin(handle)

    def put(self, rows: Iterable[pd.DataFrame]) -> tuple[list[int], list[int]]:
        """Stores rows as further parts of their slots; gives the slots, and those of them that had none waiting."""
        parts, new = {}, []
        for batch in rows:
            for slot, part in batch.groupby(batch["at"] // (self.slot * 1_000_000)):
                number = int(slot)
                if number not in parts:
                    held = self.parts.getValue((number,))
                    parts[number] = held[0] if held else 0
                    new += [] if held else [number]
                self.waiting.updateValue((number, parts[number]), tuple(part[c].tolist() for c in self.columns))
                parts[number] += 1
        for number, n in parts.items():
            self.parts.updateValue((number,), (n,))
        return sorted(parts), new

    def pick(self, number: int) -> list[tuple]:
        """The rows that wait in a slot, in order; they are removed."""
        held, rows = self.parts.getValue((number,)), []
        if held:
            self.parts.removeKey((number,))
            for part in range(held[0]):
                rows += zip(*self.waiting.getValue((number, part)), strict=True)
                self.waiting.removeKey((number, part))
        return sorted(rows)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for number in self.put(rows)[1]:
            self.handle.registerTimer((number + 1) * self.slot * 1000)
            self.handle.registerTimer((number + 1 + self.linger) * self.slot * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs() // 1000
        number = end // self.slot - 1
        rows = self.pick(number)
        if rows:
            yield from self.take(key[0], number, rows)
        yield from self.expire(key[0], end * 1_000_000)

    def close(self) -> None:
        pass


class RateLimit(InOrder):
    """Users and times of the last window, by slot; slots that lie before it are dropped from the front."""

    columns = {"at": "bigint", "seq": "bigint", "user_id": "bigint"}

    def __init__(self, limit: int, seconds: int, slot: int) -> None:
        super().__init__(slot, seconds)
        self.limit, self.width = limit, seconds * 1_000_000

    def begin(self, handle) -> None:
        self.times = handle.getMapState("times", "slot bigint", "users array<bigint>, times array<bigint>")

    def take(self, key, number: int, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        """Rows are (at, seq, user); one without a user is the key's own."""
        rows = [(*r, key)[:3] for r in rows]
        windows = defaultdict(deque)
        for at, user in sorted((at, user) for users, times in self.times.values() for user, at in zip(users, times, strict=True)):
            windows[user].append(at)
        counts = []
        for at, _, user in rows:
            window = windows[user]
            window.append(at)
            while window[0] <= at - self.width:
                window.popleft()
            counts.append(len(window))
        last = [(user, at) for at, _, user in rows if at > (number + 1) * self.slot * 1_000_000 - self.width]
        if last:
            self.times.updateValue((number,), tuple(map(list, zip(*last, strict=True))))
        yield pd.DataFrame({"user_id": [user for _, _, user in rows], "event_id": [seq for _, seq, _ in rows], "in_window": counts, "blocked": [c > self.limit for c in counts]})

    def expire(self, key, end: int) -> Iterator[pd.DataFrame]:
        for (number,) in list(self.times.keys()):
            if (number + 1) * self.slot * 1_000_000 <= end - self.width:
                self.times.removeKey((number,))
        return iter(())


class Sessions(InOrder):
    """The open sessions of a bucket by their ids: first and last action, how many, how many good."""

    columns = {"at": "bigint", "seq": "bigint", "action": "string", "ok": "boolean", "session_id": "string"}
    names = ["session_id", "start_time", "end_time", "actions", "successful", "status"]
    held = {"ids": "string", "firsts": "bigint", "lasts": "bigint", "actions": "bigint", "successful": "bigint"}

    def __init__(self, idle: int, slot: int) -> None:
        super().__init__(slot, idle)
        self.idle = idle * 1_000_000

    def begin(self, handle) -> None:
        self.open = handle.getValueState("open", ", ".join(f"{c} array<{t}>" for c, t in self.held.items()))

    def load(self) -> dict[str, tuple]:
        held = self.open.get()
        return {row[0]: row[1:] for row in zip(*held, strict=True)} if held else {}

    def save(self, sessions: dict[str, tuple]) -> None:
        if sessions:
            self.open.update(tuple(map(list, zip(*((key, *held) for key, held in sessions.items()), strict=True))))
        else:
            self.open.clear()

    def follow(self, sessions: dict[str, tuple], rows: list[tuple], cut: bool = True) -> Iterator[pd.DataFrame]:
        """Sessions that the rows end, and with `cut` those that were idle before a row; `sessions` is kept up with them."""
        done = []
        for at, _, action, ok, key in rows:
            held = sessions.pop(key, None)
            if held and cut and at >= held[1] + self.idle:
                done.append((key, *held, "expired"))
                held = None
            held = (min(held[0], at), max(held[1], at), held[2] + 1, held[3] + bool(ok)) if held else (at, at, 1, int(bool(ok)))
            if action == "end":
                done.append((key, *held, "completed"))
            else:
                sessions[key] = held
        if done:
            yield pd.DataFrame(done, columns=self.names)

    def take(self, key, number: int, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        sessions = self.load()
        yield from self.follow(sessions, rows)
        self.save(sessions)

    def expire(self, key, end: int) -> Iterator[pd.DataFrame]:
        sessions = self.load()
        done = [(key, *held, "expired") for key, held in sessions.items() if held[1] + self.idle <= end]
        if done:
            self.save({key: held for key, held in sessions.items() if held[1] + self.idle > end})
            yield pd.DataFrame(done, columns=self.names)


class BatchSessions(Sessions):
    """Sessions that expire between micro-batches only: rows are taken with their batch, slot after slot."""

    def wake(self, sessions: dict[str, tuple], watermark: int) -> None:
        if sessions:
            first = min(held[1] for held in sessions.values()) + self.idle
            self.handle.registerTimer(max(first // 1000, watermark + 1))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        numbers, _ = self.put(rows)
        sessions = self.load()
        for number in numbers:
            yield from self.follow(sessions, self.pick(number), cut=False)
        self.save(sessions)
        self.wake(sessions, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        yield from self.expire(key[0], (watermark + 1) * 1000 - 1)
        self.wake(self.load(), watermark)


class Cache(StatefulProcessor):
    """The last value of a key by (at, value); each Arrow batch gives its own last one."""

    def __init__(self, kind: str, seconds: int) -> None:
        self.kind, self.seconds = kind, seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", f"at bigint, value {self.kind}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.held.get()
        new = max(max(zip(b["at"].tolist(), b["value"].tolist(), strict=True)) for b in rows)
        if held and tuple(held) > new:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.held.update(new)
        self.handle.registerTimer(max(new[0] // 1000 + self.seconds * 1000, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame({"key": [str(key[0])], "value": [str(new[1])], "expired": [False]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield pd.DataFrame({"key": [str(key[0])], "value": [None], "expired": [True]})

    def close(self) -> None:
        pass


def _clocked(rows: DataFrame, late: int, ahead: int) -> DataFrame:
    """With `at` in microseconds, and a watermark `late` seconds behind; `ahead` puts it that far past the last row."""
    keyed_state(rows.sparkSession)
    rows = rows.withColumns({"at": F.unix_micros("ts"), "clock": F.col("ts") + F.make_dt_interval(secs=F.lit(ahead + late if ahead else 0))})
    return rows.withWatermark("clock", f"{late} seconds").drop("ts")


def _dealt(rows: DataFrame, key: str, buckets: int):
    return rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets))).groupBy("bucket")


def rate_limited(events: DataFrame, limit: int, seconds: int = 60, slot: int | None = None, late: int = 60, whole: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """ST2: each request of a user with how many came in its window, itself included, and whether it is blocked.

    Requests are taken in the order of (ts, event_id), when the watermark has passed their slot (as long as the window,
    if not given). Rows without user or time are left out. `whole` says that all input comes in one micro-batch: the
    watermark then goes past the last row, so that none is left waiting.
    """
    slot = slot or seconds
    rows = events.where("user_id is not null and ts is not null").select("user_id", "ts", F.col("event_id").alias("seq"))
    kept = _dealt(_clocked(rows, late, 2 * slot + seconds if whole else 0), "user_id", buckets)
    return kept.transformWithStateInPandas(RateLimit(limit, seconds, slot), "user_id bigint, event_id bigint, in_window bigint, blocked boolean", "append", "EventTime")


def _sessions(actions: DataFrame, processor: Sessions, late: int, ahead: int, buckets: int) -> DataFrame:
    rows = actions.where("ts is not null").select("session_id", "ts", F.coalesce("seq", F.lit(-1)).alias("seq"), F.coalesce("action", F.lit("update")).alias("action"), F.coalesce("ok", F.lit(False)).alias("ok"))
    kept = _dealt(_clocked(rows.where("session_id is not null"), late, ahead), "session_id", buckets)
    out = kept.transformWithStateInPandas(processor, "session_id string, start_time bigint, end_time bigint, actions bigint, successful bigint, status string", "append", "EventTime")
    return out.withColumns({c: F.timestamp_micros(c) for c in ("start_time", "end_time")})


def idle_sessions(actions: DataFrame, idle: int = 1800, slot: int | None = None, late: int = 60, whole: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """ST4 by explicit ids: sessions out of (session_id, ts, seq, action, ok), action being create, update or end.

    A session begins with its first action, whichever that is. It is completed by an end, and expired by `idle` seconds
    without an action; what comes after begins another one. `slot` and `whole` are those of `rate_limited`.
    """
    slot = slot or idle
    return _sessions(actions, Sessions(idle, slot), late, 2 * slot + idle if whole else 0, buckets)


def session_states(actions: DataFrame, idle: int = 1800, slot: int = 86_400, late: int = 60, buckets: int = BUCKETS) -> DataFrame:
    """ST4 by explicit ids as rows arrive: those of `idle_sessions`, but an action joins the open session of its id.

    A session comes out with its micro-batch when it ends, as completed, or when the watermark is `idle` seconds past its
    last action, as expired. An action after the end begins another one. Rows of a micro-batch are taken by slots.
    """
    return _sessions(actions, BatchSessions(idle, slot), late, 0, buckets)


def cached_results(rows: DataFrame, key: str, value: str, seconds: int, late: int = 60) -> DataFrame:
    """ST6: the last value of each key by event time `ts`, until the watermark is `seconds` past it; then it expires.

    A row that is older than the one that is held has no effect; equal times go by value. Rows without time or value
    are left out.
    """
    kind = rows.schema[value].dataType.simpleString()
    kept = rows.where(F.col("ts").isNotNull() & F.col(value).isNotNull()).select(F.col(key).alias("key"), "ts", F.col(value).alias("value"))
    return _clocked(kept, late, 0).groupBy("key").transformWithStateInPandas(Cache(kind, seconds), "key string, value string, expired boolean", "update", "EventTime")
