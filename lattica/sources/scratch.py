"""Tables in a folder that driver and executors share, to cut lineage or to read a costly result more than once."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Most rows and bytes of an Arrow batch. Texts are long, and batches lie outside the executor's heap.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2048, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the session's own one where its checkpoints go, which Spark removes when the driver ends.

    Where ``spark.checkpoint.dir`` is unset, a local master gets a temporary folder; on a cluster that is an error.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lattica-")
        context.setCheckpointDir(base)
    own = context._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/lattica-{context.applicationId}")
    files = own.getFileSystem(context._jsc.hadoopConfiguration())
    if not files.exists(own):
        files.mkdirs(own)
        files.deleteOnExit(own)
    return f"{own.toString()}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows and reads them back, so that lost executors recompute from files."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch bounds to ``BATCH`` where they are higher or none."""
    for key, most in BATCH.items():
        digits = re.match(r"\d+", spark.conf.get(key))
        if not digits or not 0 < int(digits[0]) <= most:
            spark.conf.set(key, str(most))
