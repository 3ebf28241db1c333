"""Shared pieces of the training-data operators: scratch tables, row keys, Arrow plumbing."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.sources.scratch import bound_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table; the path is only ever opened by Spark's readers."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The session's own folder, shared by driver and executors; Spark removes it when the driver ends.

    ``spark.checkpoint.dir`` names its parent. Where that is unset, a local master gets a temporary folder, made once;
    on a cluster, where executors would each write to their own disk, that is an error.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lattica-")
        context.setCheckpointDir(base)
    where = f"{base.rstrip('/')}/lattica-{context.applicationId}"
    path = context._jvm.org.apache.hadoop.fs.Path(where)
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    if not files.exists(path):
        files.mkdirs(path)
        files.deleteOnExit(path)
    return where


def materialize(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Writes ``df`` to the session's shared folder and reads it back, so lost executors recompute from files; ``options`` are the writer's."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Deletes the files of a frame that ``materialize`` returned, once nothing reads it any more."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of text, about, and rows that a kernel sees at once.
PIECE_BYTES, PIECE_ROWS = 1 << 20, 1024


def pieces(batch: pa.RecordBatch, text_at: int = 1) -> Iterator[pa.RecordBatch]:
    """Slices of bounded text size; a longer text is a slice of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        n = max(1, min(PIECE_ROWS, int(np.searchsorted(sizes, before + PIECE_BYTES, "right")) - at))
        yield batch.slice(at, n)
        at += n


def give_back() -> None:
    """Hands memory that a kernel no longer needs back to the system, as idle workers stay beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has such a call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.Table], schema: str, text_at: int = 1) -> DataFrame:
    """``mapInArrow`` over record batches that are cut to bounded pieces of text before ``fn`` sees them."""

    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text_at):
                yield from fn(piece).to_batches()
        give_back()

    return df.mapInArrow(run, schema)


def arrow_filter(df: DataFrame, keep: Callable[[pa.RecordBatch], list[bool] | np.ndarray], text_col: str) -> DataFrame:
    """Rows of ``df``, with all columns, for which ``keep`` says so of bounded pieces; no exchange."""
    at = df.columns.index(text_col)
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, at):
                yield piece.filter(pa.array(keep(piece), pa.bool_()))
        give_back()

    return df.mapInArrow(run, df.schema)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows, with all columns, written with a number of their own; and the number's column, which clashes with none."""
    number = fresh(docs, "row_no")
    return materialize(docs.withColumn(number, F.monotonically_increasing_id()), "numbered"), number


def of_numbers(rows: DataFrame, number: str, chosen: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of ``numbered`` whose number is (``left_anti``: is not) in the one column of ``chosen``, without the number.

    Numbers are unique, so no key is hot; ids of any type, null ids and repeated rows make no difference. Rows to keep are
    most of the table, so they are merged at every size and never sent whole to each task; rows to leave out may be.
    """
    wanted = chosen.toDF(number)
    wanted = wanted.hint("merge") if how == "left_semi" else wanted
    return rows.join(wanted, number, how).select(*[F.col(f"`{c}`") for c in rows.columns if c != number])


def by_run(rows: DataFrame, told: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join of ``rows``, which have a column ``run``, with ``told``, which has each key once.

    ``told`` first meets the distinct keys of each run, then each run's rows: a key that very many rows have never
    brings more than one run's rows together.
    """
    return rows.join(rows.select("run", *keys).distinct().join(told, keys, how), ["run", *keys])


def dealt(rows: DataFrame, by: str) -> DataFrame:
    """Adds ``run``, a number by hash of a column that is never hot."""
    return rows.withColumn("run", F.pmod(F.xxhash64(by), F.lit(4 * n_partitions(rows.sparkSession))).cast("int"))


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
