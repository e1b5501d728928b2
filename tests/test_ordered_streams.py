"""Streams in the order of time: several micro-batches in any order within the watermark, a hot user, odd rows."""

from __future__ import annotations

import os
import random
from datetime import datetime, timedelta

import pytest

from siltstone.plans.page_queries import gathered
from siltstone.streaming import ordered
from siltstone.streaming.streams import EVENTS, event_stream

START = datetime(2024, 3, 1)


def stored(spark, folder, batches):
    """Each batch of (event_id, second, user_id) as a file of its own, in this order."""
    for n, rows in enumerate(batches):
        full = [(e, None if s is None else START + timedelta(seconds=s), u, "view", 1.0, "{}") for e, s, u in rows]
        spark.createDataFrame(full, EVENTS).coalesce(1).write.parquet(f"{folder}/written-{n}")
        part = next((folder / f"written-{n}").glob("part-*.parquet"))
        os.utime(part.rename(folder / f"events-{n}.parquet"), (1_700_000_000 + n, 1_700_000_000 + n))
    return str(folder)


def hot_rows():
    """A third of all rows are user 1's."""
    rng = random.Random(5)
    return [(e, rng.randrange(3000), 1 if e % 3 == 0 else rng.randrange(2, 40)) for e in range(1500)]


def brute(rows, limit, seconds):
    out = {}
    for e, s, u in rows:
        n = sum(1 for f, t, v in rows if v == u and s - seconds < t and (t, f) <= (s, e))
        out[e] = (n, n > limit)
    return out


def limited(spark, folder, files, **options):
    df = gathered(ordered.rate_limited(event_stream(spark, folder, files), 4, 60, **options))
    rows = [(r["event_id"], (r["in_window"], r["blocked"])) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


@pytest.mark.parametrize("slot", [None, 25, 600])
def test_rate_limit_in_one_batch_is_exact(slot, spark, tmp_path):
    rows = hot_rows()
    folder = stored(spark, tmp_path, [rows[:700], rows[700:]])
    assert limited(spark, folder, None, slot=slot, whole=True) == brute(rows, 4, 60)


def test_rate_limit_over_batches_gives_what_the_watermark_has_passed(spark, tmp_path):
    rows = sorted(hot_rows(), key=lambda r: r[1])
    batches = [rows[i : i + 300] for i in range(0, 1500, 300)]
    late = [batches[0][-20:], batches[0][:-20] + batches[1], *batches[2:]]
    got = limited(spark, stored(spark, tmp_path, late), 1, late=600)
    want = brute(rows, 4, 60)
    assert got.items() <= want.items()
    passed = max(s for _, s, _ in rows) - 600
    assert {e for e, s, _ in rows if (s // 60 + 1) * 60 < passed} <= got.keys()


def test_a_call_takes_one_slot_of_a_hot_user():
    class Held(dict):
        getValue, updateValue, removeKey = dict.get, dict.__setitem__, dict.pop

    limit = ordered.RateLimit(4, 60, 60)
    limit.times = Held()
    limit.values = limit.times.values
    for number in range(50):
        rows = [(number * 60_000_000 + i, i) for i in range(100)]
        frames = list(limit.take(1, number, rows))
        assert len(frames) == 1 and len(frames[0]) == 100
        list(limit.expire(1, (number + 1) * 60_000_000))
        assert len(limit.times) <= 2


def test_rows_without_user_or_time_and_repeated_rows(spark, tmp_path):
    rows = [(1, 10, 7), (1, 10, 7), (2, None, 7), (3, 12, None), (4, 12, 7)]
    got = gathered(ordered.rate_limited(event_stream(spark, stored(spark, tmp_path, [rows]), None), 2, 60, whole=True))
    assert sorted((r["event_id"], r["in_window"], r["blocked"]) for r in got.collect()) == [(1, 1, False), (1, 2, False), (4, 3, True)]


def actions(spark, folder, files):
    from pyspark.sql import functions as F

    e = event_stream(spark, folder, files)
    kind = F.when(F.col("event_id") % 10 == 9, "end").otherwise("update")
    return e.select(F.col("user_id").cast("string").alias("session_id"), "ts", F.col("event_id").alias("seq"), kind.alias("action"), (F.col("event_id") % 4 > 0).alias("ok"))


def brute_sessions(rows, idle):
    out = []
    for u in {u for _, _, u in rows}:
        held = None
        for s, e in sorted((s, e) for e, s, v in rows if v == u):
            if held and s >= held[1] + idle:
                out.append((str(u), *held, "expired"))
                held = None
            held = (held[0], s, held[2] + 1, held[3] + (e % 4 > 0)) if held else (s, s, 1, int(e % 4 > 0))
            if e % 10 == 9:
                out.append((str(u), *held, "completed"))
                held = None
        if held:
            out.append((str(u), *held, "expired"))
    return sorted(out)


@pytest.mark.parametrize("slot", [None, 20])
def test_sessions_are_the_same_however_rows_arrive(slot, spark, tmp_path):
    rows = hot_rows()
    got = gathered(ordered.idle_sessions(actions(spark, stored(spark, tmp_path, [rows]), None), 45, slot, whole=True)).collect()
    second = lambda t: int((t - START).total_seconds())
    assert sorted((r[0], second(r[1]), second(r[2]), r[3], r[4], r[5]) for r in got) == brute_sessions(rows, 45)


def test_cache_over_batches_holds_the_last_and_expires(spark, tmp_path):
    batches = [[(1, 10, 1), (5, 10, 1), (2, 5, 1), (3, 20, 2)], [(4, 8, 1), (6, 25, 2)], [(7, 500, 3)], [(8, 510, 3)]]
    df = gathered(ordered.cached_results(event_stream(spark, stored(spark, tmp_path, batches), 1), "user_id", "event_id", 100), "update")
    got = sorted((r["key"], r["value"], r["expired"]) for r in df.collect() if not r["expired"])
    assert got == [("1", "5", False), ("2", "3", False), ("2", "6", False), ("3", "7", False), ("3", "8", False)]
    assert sorted(r["key"] for r in df.collect() if r["expired"]) == ["1", "2"]


class Store(dict):
    """A map state that counts its calls."""

    calls = 0

    def _called(name):  # noqa: N805
        def call(self, *args):
            Store.calls += 1
            return getattr(dict, name)(self, *args)

        return call

    getValue, updateValue, removeKey = _called("get"), _called("__setitem__"), _called("pop")


class Handle:
    def __init__(self):
        self.timers = []

    def getMapState(self, *_):
        return Store()

    def registerTimer(self, at):
        self.timers.append(at)


def test_calls_of_the_state_store_do_not_grow_with_the_users_of_a_bucket():
    import pandas as pd

    def calls(users):
        limit = ordered.RateLimit(4, 60, 60)
        limit.init(Handle())
        Store.calls = 0
        frame = pd.DataFrame([(u * 1000, e, u) for e, u in enumerate(range(users))], columns=["at", "seq", "user_id"])
        list(limit.handleInputRows((0,), iter([frame]), None))
        assert len(limit.pick(0)) == users and not limit.waiting
        return Store.calls

    assert calls(2000) == calls(1)


def test_further_rows_of_a_slot_do_not_rewrite_those_that_wait():
    import pandas as pd

    limit = ordered.RateLimit(4, 60, 60)
    limit.init(Handle())
    for n in range(3):
        list(limit.handleInputRows((0,), iter([pd.DataFrame({"at": [5 - n], "seq": [n], "user_id": [1]})]), None))
    assert [len(ats) for ats, *_ in limit.waiting.values()] == [1, 1, 1] and len(limit.handle.timers) == 2
    assert limit.pick(0) == [(3, 2, 1), (4, 1, 1), (5, 0, 1)] and not limit.parts


@pytest.mark.parametrize("buckets", [1, 7])
def test_streams_are_the_same_however_keys_are_dealt(buckets, spark, tmp_path):
    rows = hot_rows()
    folder = stored(spark, tmp_path, [rows[:700], rows[700:]])
    assert limited(spark, folder, None, slot=25, whole=True, buckets=buckets) == brute(rows, 4, 60)
    got = gathered(ordered.idle_sessions(actions(spark, folder, None), 45, 20, whole=True, buckets=buckets)).collect()
    second = lambda t: int((t - START).total_seconds())
    assert sorted((r[0], second(r[1]), second(r[2]), r[3], r[4], r[5]) for r in got) == brute_sessions(rows, 45)


def test_session_states_in_buckets_join_within_a_batch_and_expire_by_the_watermark(spark, tmp_path):
    batches = [[(e, s, u) for e, s, u in hot_rows()], [(5000 + u, 90_000, u) for u in range(1, 3)], [(6009, 90_010, 1)], [(6018, 200_000, 99)]]
    got = gathered(ordered.session_states(actions(spark, stored(spark, tmp_path, batches), 1), 1800, slot=500, buckets=2)).collect()
    second = lambda t: int((t - START).total_seconds())
    first = brute_sessions(batches[0], 10**9)
    joined = [r for r in first if not (r[5] == "expired" and r[0] in ("1", "2"))]
    late = {u: next((r for r in first if r[0] == u and r[5] == "expired"), None) for u in ("1", "2")}
    for u, n, good, end, status in (("1", 2, 2, 90_010, "completed"), ("2", 1, 1, 90_000, "expired")):
        held = late[u]
        joined.append((u, held[1] if held else 90_000, end, n + (held[3] if held else 0), good + (held[4] if held else 0), status))
    assert sorted((r[0], second(r[1]), second(r[2]), r[3], r[4], r[5]) for r in got) == sorted(joined)
