"""Bounded samples of labelled texts for the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of text of each label that a sample holds at most.
SAMPLE_BYTES = 6 << 20
#: Longer texts than this share of the bound come after all others.
SHARE = 16
#: Different texts of one id that a sample holds at most.
EACH = 16


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold: int, out_of: int, sample: int, most: int = SAMPLE_BYTES) -> tuple[list[bytes], np.ndarray]:
    """Texts and labels of at most ``sample`` rows of each label outside the held-out fold; equal texts once. At most ``most`` bytes of text of each label: ids are chosen first, by hash, of those that have a document; then texts up to the bound.

    The first texts of all ids come before their second ones, of which an id has ``EACH`` at most, and very long texts
    come last, the shorter first, so that neither takes the room of others. A label whose rows with a document leave no
    text in the sample is an error.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % out_of != fold))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).join(docs.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("order", F.xxhash64("doc_id"))
    ids = known.where("y = 1").orderBy("order", "doc_id").limit(sample).unionByName(known.where("y = 0").orderBy("order", "doc_id").limit(sample))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    once = texts.groupBy("text").agg(F.min(F.struct("order", "doc_id", "y")).alias("least")).select("text", "least.*").withColumn("size", F.octet_length("text"))
    late = F.when(F.col("size") > most // SHARE, F.col("size")).otherwise(0)
    # Spark limits the texts of an id before it exchanges them, so an id with very many is no hot key.
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("late", "text"))
    ranked = once.withColumn("late", late).withColumn("nth", nth).where(F.col("nth") <= EACH)
    # The order and the bound hold the same rows whatever the partitions are.
    running = F.sum("size").over(Window.partitionBy("y").orderBy("late", "nth", "order", "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0))
    rows = ranked.withColumn("before", running).where(F.col("before") <= most).select("text", "y", "order").collect()
    lost = {0, 1} - {r["y"] for r in rows}
    if lost and (of := known.where(F.col("y").isin(*lost)).select("y").first()):
        raise ValueError(f"no text of {label} {of['y']} is in the sample, though rows have that label")
    picked = sorted(rows, key=lambda r: (r["order"], r["text"]))
    return [r["text"].encode() for r in picked], np.array([r["y"] for r in picked], np.int64)
