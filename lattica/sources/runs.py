"""Records of runs, results as JSON, and synthetic corpora for fixtures."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = "run_id string, step string, status string, n_rows long, details string, at timestamp"


def log_run(spark: SparkSession, path: str, run_id: str, step: str, status: str, n_rows: int | None = None, details: dict | None = None) -> None:
    """Appends one row to the processing log."""
    row = spark.createDataFrame([(run_id, step, status, n_rows, json.dumps(details or {}))], "run_id string, step string, status string, n_rows long, details string")
    row.withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)


def run_summary(log: DataFrame) -> DataFrame:
    """run_id, steps, failed, n_rows, started, finished."""
    return log.groupBy("run_id").agg(F.count(F.lit(1)).alias("steps"), F.count_if(F.col("status") != "ok").alias("failed"), F.sum("n_rows").alias("n_rows"), F.min("at").alias("started"), F.max("at").alias("finished"))


def save_results(df: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def guarded(df: DataFrame, checks: dict[str, str]) -> DataFrame:
    """Adds ``errors``: names of the SQL conditions that a row fails, so that bad rows are kept and counted instead of raised."""
    return df.withColumn("errors", F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(c), F.lit(False)), F.lit(n)) for n, c in checks.items()])))


def synthetic_vectors(spark: SparkSession, n: int, dim: int = 64, clusters: int = 5, spread: float = 0.3, seed: int = 42) -> DataFrame:
    """id, label, v: Gaussian clusters around random centres. Centres come from hashes of label and dimension."""
    centre = lambda d: F.pmod(F.xxhash64("label", F.lit(d), F.lit(seed)), F.lit(2001)) / 1000.0 - 1.0
    rows = spark.range(n).withColumn("label", (F.col("id") % clusters).cast("int"))
    return rows.select("id", "label", F.array(*[centre(d) + F.randn(seed + d) * spread for d in range(dim)]).alias("v"))


def synthetic_counts(spark: SparkSession, n: int, shape: float = 1.5, seed: int = 42) -> DataFrame:
    """id, n: Pareto-distributed counts of at least 1."""
    return spark.range(n).select("id", F.floor(F.pow(1 - F.rand(seed), F.lit(-1.0 / shape))).cast("long").alias("n"))


def synthetic_alpha_points(spark: SparkSession, n: int, alpha: float = 1.5, noise: float = 0.02, seed: int = 42) -> DataFrame:
    """id, context, base, amplified: a power law with normal noise."""
    p = spark.range(n).select("id", F.rand(seed).alias("context"), (F.rand(seed + 1) * 0.5 + 0.3).alias("base"))
    return p.withColumn("amplified", F.greatest(F.lit(0.0), F.col("base") * F.pow("context", F.lit(alpha)) + F.randn(seed + 2) * noise))
