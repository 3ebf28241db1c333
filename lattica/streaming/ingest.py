"""Structured Streaming over the same operators: windowed metrics, and idempotent ingestion of documents as chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import text as tx
from lattica.sources.store import VersionedStore


def read_stream(spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet", files: int = 100) -> DataFrame:
    """New files of a folder, at most ``files`` a batch."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(folder)


def window_metrics(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """start, event_type, n, total by tumbling windows; rows later than the watermark are dropped."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return by.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """user_id, start, finish, n of each user's sessions, which a gap ends."""
    by = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap))
    return by.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("finish"), "n")


def ingest(documents: DataFrame, store: VersionedStore, checkpoint: str, size: int = 1024, overlap: int = 200):  # noqa: ANN201
    """Starts a query that puts new documents (doc_id, text) and their chunks into the store, both tables in one version.

    A batch that runs again after a failure replaces what it wrote, so each document is there once.
    """

    def put(batch: DataFrame, _: int) -> None:
        docs = batch.select("doc_id", "text").dropDuplicates(["doc_id"])
        if docs.isEmpty():
            return
        chunks = docs.select("doc_id", F.posexplode(tx.word_windows(F.col("text"), size, overlap)).alias("chunk_index", "text"))
        store.upsert({"documents": docs, "chunks": chunks}, "doc_id")

    return documents.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
