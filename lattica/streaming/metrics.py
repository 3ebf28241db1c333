"""Figures of runs as tables: counts that Spark observes while it writes, and rates of streaming queries."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

RUN = "run string, measure string, value double"
PROGRESS = "query string, batch long, rows long, rows_a_second double, seconds double, at string"


def observed_write(df: DataFrame, path: str, run: str, measures: dict[str, Column], form: str = "parquet") -> DataFrame:
    """Writes the rows once and returns run, measure, value of the aggregates, which Spark takes on the way: nothing is read again for them."""
    seen = Observation(run)
    df.observe(seen, *[c.alias(n) for n, c in measures.items()]).write.format(form).mode("append").save(path)
    got = seen.get
    return df.sparkSession.createDataFrame([(run, n, None if got[n] is None else float(got[n])) for n in measures], RUN)


def record(figures: DataFrame, path: str) -> None:
    """Appends a run's figures to the table of all runs."""
    figures.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)


class Rates(StreamingQueryListener):
    """Keeps a row of each batch of the session's streaming queries until ``flush`` appends them to a table."""

    def __init__(self) -> None:
        self._rows: list[tuple] = []
        self._lock = threading.Lock()

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        with self._lock:
            self._rows.append((p.name or str(p.id), p.batchId, p.numInputRows, float(p.processedRowsPerSecond), p.batchDuration / 1000.0, p.timestamp))

    def onQueryIdle(self, event: QueryIdleEvent) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        pass

    def flush(self, spark: SparkSession, path: str) -> int:
        """Appends what has come so far; returns the number of rows."""
        with self._lock:
            rows, self._rows = self._rows, []
        if rows:
            spark.createDataFrame(rows, PROGRESS).coalesce(1).write.mode("append").parquet(path)
        return len(rows)
