"""Queries that run a stream to its end and read what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.plans.registry import query
from lattica.sources.scratch import shared_folder
from lattica.sources.store import merge
from lattica.streaming import ingest, sessions


def run_to_end(df: DataFrame, name: str, keys: list[str] | None = None) -> DataFrame:
    """Runs an aggregating stream over all files there are and returns its final rows.

    With ``keys`` batches bring the rows that changed, which replace those of their keys, and the watermark drops state.
    Without, each batch brings all rows: windows of sessions have no such mode. A batch that runs again writes the same.
    """
    out = shared_folder(df.sparkSession, name)
    last = -1

    def keep(batch: DataFrame, n: int) -> None:
        nonlocal last
        rows = merge(batch.sparkSession.read.schema(batch.schema).parquet(f"{out}/rows-{n - 1}"), batch, keys) if keys and n else batch
        rows.write.mode("overwrite").parquet(f"{out}/rows-{n}")
        last = n

    df.writeStream.outputMode("update" if keys else "complete").foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{out}/rows-{last}") if last >= 0 else df.sparkSession.createDataFrame([], df.schema)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as a stream, be it one file or a folder of files."""
    table = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(table).schema
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    folder = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    return (ingest.read_stream(spark, table, schema) if folder else ingest.read_stream(spark, sf_dir, schema, "events.parquet")).withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_daily_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_to_end(ingest.window_metrics(_events(spark, sf_dir)), "daily", ["start", "event_type"]).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events), s AS (SELECT user_id, ts, sum(CASE WHEN b IS NULL OR ts >= b + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM l)
SELECT user_id, count(DISTINCT k) AS sessions, count(*) AS n FROM s GROUP BY 1""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users by state and timers, appended as they end; a last row of no user, far ahead, ends those that are open."""
    out = shared_folder(spark, "sessions")
    events = _events(spark, sf_dir).select("user_id", "ts")
    spark.createDataFrame([], events.schema).write.parquet(f"{out}/closing")
    both = lambda: events.unionByName(ingest.read_stream(spark, f"{out}/closing", events.schema))
    run = lambda: sessions.append(sessions.sessions(both().where("user_id IS NOT NULL AND ts IS NOT NULL"), 6 * 3600 * 1000, "1 day"), f"{out}/rows", f"{out}/state")
    run()
    for year in (2200, 2201):
        spark.sql(f"SELECT CAST(-1 AS BIGINT) AS user_id, TIMESTAMP '{year}-01-01 00:00:00' AS ts").write.mode("append").parquet(f"{out}/closing")
        run()
    s = spark.read.schema(sessions.SESSION).parquet(f"{out}/rows").where("user_id <> -1")
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("n"))
