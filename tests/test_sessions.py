"""Sessions by state: restarts lose and double nothing, late rows join sessions, state ends with its timer."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lattica.streaming import ingest, sessions

SCHEMA = "user_id long, ts timestamp"
GAP = 60_000


def brute(rows):
    out = []
    for user in {u for u, _ in rows}:
        out += [(user, a, b + GAP, n) for a, b, n in sessions.merged([(t, t, 1) for u, t in rows if u == user], GAP)]
    return sorted(out)


def test_merged():
    assert sessions.merged([(0, 0, 1), (120_000, 120_000, 1), (59_999, 59_999, 1)], GAP) == [(0, 59_999, 2), (120_000, 120_000, 1)]
    assert sessions.merged([(0, 50, 2), (20, 30, 1), (110_000, 110_000, 1), (55_000, 55_000, 1)], GAP) == [(0, 110_000, 5)]


def test_restarts_lose_and_double_nothing(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.randint(1, 5), 10**7 + rng.randint(0, 90) * 20_000) for _ in range(300)]
    rows.sort(key=lambda r: r[1] + rng.randint(0, 50_000))  # somewhat out of order, within the watermark
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def put(part):
        made = spark.createDataFrame(part, "user_id long, ms long").select("user_id", F.timestamp_millis("ms").alias("ts"))
        made.coalesce(1).write.mode("append").parquet(src)

    def run():
        sessions.append(sessions.sessions(ingest.read_stream(spark, src, SCHEMA), GAP, "3 minutes"), out, state)

    got = lambda: sorted((r["user_id"], int(r["start"]), int(r["finish"]), r["n"]) for r in spark.read.schema(sessions.SESSION).parquet(out).select("user_id", F.unix_millis("start").alias("start"), F.unix_millis("finish").alias("finish"), "n").collect())
    put(rows[:120])
    run()
    some = got()
    assert some and len(some) < len(brute(rows))
    run()  # a restart without new rows
    assert got() == some
    put(rows[120:200])
    run()
    put(rows[200:])
    run()
    for far in (10**10, 2 * 10**10):
        put([(0, far)])
        run()
    assert [r for r in got() if r[0]] == brute(rows)
    put([(1, 1000)])  # far behind the watermark
    run()
    assert [r for r in got() if r[0]] == brute(rows)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").find("RocksDB") < 0


class Calls:
    """A handle and a state that count what they are asked for."""

    def __init__(self):
        self.timers, self.held, self.calls = set(), None, 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.held

    def update(self, value):
        self.calls += 1
        self.held = value

    def clear(self):
        self.calls += 1
        self.held = None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


def test_many_users_and_sessions_cost_few_calls():
    at = lambda ms: type("At", (), {"getCurrentWatermarkInMs": lambda s: ms, "getExpiryTimeInMs": lambda s: ms})()
    handle, p = Calls(), sessions.Sessions(GAP)
    p.init(handle)
    rows = [(u, k * 2 * GAP) for k in range(200) for u in (7, 8, 9)]
    frame = lambda part: iter([pd.DataFrame(part, columns=["user_id", "ms"])])
    assert list(p.handleInputRows((1,), frame(rows[300:]), at(0))) == []
    assert list(p.handleInputRows((1,), frame(rows[:300]), at(0))) == []
    assert handle.timers == {GAP}
    handle.timers.clear()
    (got,) = p.handleExpiredTimer((1,), at(rows[449][1] + GAP), at(GAP))
    assert got["n"].tolist() == [1] * 450
    assert handle.timers == {rows[450][1] + GAP}
    handle.timers.clear()
    (got,) = p.handleExpiredTimer((1,), at(10**9), at(rows[450][1] + GAP))
    assert sorted(got["user_id"]) == [7] * 50 + [8] * 50 + [9] * 50
    assert handle.held is None
    assert handle.calls < 16


def test_sessions_of_many_users_are_those_of_each():
    rng = np.random.default_rng(4)
    held = np.stack([rng.integers(-3, 4, 400), rng.integers(0, 10**7, 400), np.zeros(400, int), rng.integers(1, 5, 400)], axis=1)
    held[:, 2] = held[:, 1] + rng.integers(0, 2 * GAP, 400)
    got = sessions.merged_by_user(held, GAP).tolist()
    assert got == [[u, *s] for u in range(-3, 4) for s in map(list, sessions.merged([tuple(r[1:]) for r in held.tolist() if r[0] == u], GAP))]
