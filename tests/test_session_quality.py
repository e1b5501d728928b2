"""Classes of sessions do not depend on how their log is split."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from siltstone.operators import aggregates as a
from siltstone.plans import catalogue


def band(mean: float) -> int:
    return 0 if mean < a.MEDIUM else 2 if mean >= a.HIGH else 1


def deciding() -> list[tuple[int, int, int]]:
    """Scores in percent whose average is in a higher band if they are added from the first to the last."""
    out = []
    for s in (120, 210):
        for x in range(1, 100):
            for y in range(1, 100):
                z = s - x - y
                if 0 < z < 100 and x % 10 and y % 10 and z % 10 and band((x / 100 + y / 100 + z / 100) / 3) > band((x / 100 + (y / 100 + z / 100)) / 3):
                    out.append((x, y, z))
    return out


def test_sums_follow_the_ids_however_the_log_is_split(spark, tmp_path):
    """The first file has the first row of each session, and the second one the others, whose sum splits had added as one."""
    scores = deciding()
    assert len(scores) > 500
    folder = tmp_path / "events.parquet"
    folder.mkdir()
    start = datetime(2024, 1, 1)
    rows = [(k * len(scores) + user, start + timedelta(seconds=k), user or None, "view", 1.0, json.dumps({"k": s[k]})) for k in range(3) for user, s in enumerate(scores)]
    rows.append((10**6, start, 10**6, "view", 1.0, '{"k": 10}'))
    names = ["event_id", "ts", "user_id", "event_type", "value", "props"]
    for name, part in (("a", rows[: len(scores)]), ("b", rows[len(scores) :])):
        table = pa.Table.from_pylist([dict(zip(names, r, strict=True)) for r in part]).cast(pa.schema([("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64()), ("event_type", pa.string()), ("value", pa.float64()), ("props", pa.string())]))
        pq.write_table(table, folder / f"{name}.parquet")
    bands = [band((x / 100 + y / 100 + z / 100) / 3) for x, y, z in scores]
    want = (bands.count(2), bands.count(1), bands.count(0) + 1, len(scores) + 1)
    got = catalogue.queries()["session_quality"](spark, str(tmp_path)).first()
    assert (got["high_quality"], got["medium_quality"], got["low_quality"], got["total_sessions"]) == want
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"create view events as select * from '{folder}/*.parquet'")
    sql = con.execute(f"select high_quality, medium_quality, low_quality, total_sessions, average_quality from ({catalogue.oracle_sql()['session_quality']})").fetchone()
    assert sql == (*want, got["average_quality"])
