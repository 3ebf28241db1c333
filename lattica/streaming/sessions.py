"""Sessions by state: each user's open sessions are kept until the watermark passes their end, then written once.

Rows are merged into the sessions of their user, also late ones that join two. Users are dealt into buckets by a hash,
and a bucket's open sessions are one state with one timer, at the first end among them; it writes all sessions that are
over by then and drops their state. So state holds open sessions only, output is appended, and a batch costs a few calls
a bucket, however many users and sessions there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Buckets of users.
BUCKETS = 1024
SESSION = "user_id long, start timestamp, finish timestamp, n long"


def merged(sessions: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """Sessions (first, last, n) in order, those less than ``gap`` apart made one."""
    out: list[tuple[int, int, int]] = []
    for a, b, n in sorted(sessions):
        if out and a < out[-1][1] + gap:
            out[-1] = (out[-1][0], max(out[-1][1], b), out[-1][2] + n)
        else:
            out.append((a, b, n))
    return out


def merged_by_user(held: np.ndarray, gap: int) -> np.ndarray:
    """``merged`` for the sessions of many users at once: rows (user, first, last, n), which come out in order."""
    if not len(held):
        return held
    user, first, last, n = held[np.lexsort((held[:, 1], held[:, 0]))].T
    # Users lie so far apart on one line that none reaches the next.
    own = np.cumsum(np.concatenate([[0], user[1:] != user[:-1]])) * (last.max() - first.min() + gap + 1)
    latest = np.maximum.accumulate(last + own)
    begins = np.flatnonzero(np.concatenate([[True], first[1:] + own[1:] >= latest[:-1] + gap]))
    return np.stack([user[begins], first[begins], np.maximum.reduceat(last, begins), np.add.reduceat(n, begins)], axis=1)


class Sessions(StatefulProcessor):
    """Writes user_id, start, finish (the last row's time and the gap), n of each session that is over; keys are buckets of users."""

    def __init__(self, gap_ms: int) -> None:
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "sessions binary, timer long")

    def _held(self) -> tuple[np.ndarray, int | None]:
        """The open sessions (user, first, last, n), and when the timer is set to."""
        held = self.open.get()
        return (np.frombuffer(bytes(held[0]), np.int64).reshape(-1, 4), held[1]) if held else (np.zeros((0, 4), np.int64), None)

    def _keep(self, now: np.ndarray, timer: int | None) -> None:
        """``timer`` is the one that is set, none if it has gone off."""
        if not len(now):
            self.open.clear()
            return
        end = int(now[:, 2].min()) + self.gap
        if end != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(end)
        self.open.update((now.tobytes(), end))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        now, timer = self._held()
        for frame in rows:
            # Rows of a batch are merged a frame at a time, so a user with very many rows never holds more than its sessions.
            ms = frame["ms"].to_numpy(np.int64)
            now = merged_by_user(np.concatenate([now, np.stack([frame["user_id"].to_numpy(np.int64), ms, ms, np.ones_like(ms)], axis=1)]), self.gap)
        self._keep(now, timer)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        end = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        now, _ = self._held()
        over = now[:, 2] + self.gap <= end
        self._keep(now[~over], None)
        at = lambda ms: pd.to_datetime(ms, unit="ms", utc=True)
        user, first, last, n = now[over].T
        yield pd.DataFrame({"user_id": user, "start": at(first), "finish": at(last + self.gap), "n": n})

    def close(self) -> None:
        pass


@contextmanager
def state_in_files(spark: SparkSession) -> Iterator[None]:
    """This kind of state needs a store of its own kind; the session's setting is put back afterwards."""
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def sessions(events: DataFrame, gap_ms: int, late: str) -> DataFrame:
    """user_id, start, finish, n of the sessions of a stream of events (user_id, ts), which a gap ends; rows older than the watermark are dropped."""
    bucket = F.pmod(F.xxhash64("user_id"), F.lit(BUCKETS)).alias("bucket")
    by = events.select(bucket, "user_id", "ts", F.unix_millis("ts").alias("ms")).withWatermark("ts", late).groupBy("bucket")
    return by.transformWithStateInPandas(Sessions(gap_ms), SESSION, "append", "EventTime")


def append(df: DataFrame, out: str, checkpoint: str) -> None:
    """Runs to the end of what there is and appends to ``out``. A run after a failure goes on from the checkpoint; the file sink keeps each batch once."""
    with state_in_files(df.sparkSession):
        df.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
