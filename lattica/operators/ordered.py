"""Ranks, running sums and neighbours over a whole table in order, without one task that sees it all.

Rows are dealt by range and written with the number of their part, so that part and order stay what they are. A window
then goes over each part, and what came before it is a sum over parts, of which there are as many as shuffle partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.vector import dot, norm, unit
from lattica.sources.scratch import settle


def _parts(df: DataFrame, order: list[Column]) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settle(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ordered")


def _earlier(parts: DataFrame, what: Column) -> DataFrame:
    """_part, _base: the sum of an aggregate over all earlier parts; one row a part."""
    by = parts.groupBy("_part").agg(what.alias("_own"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return by.select("_part", F.coalesce(F.sum("_own").over(w), F.lit(0)).alias("_base"))


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds the row's number in the order, from 1."""
    p = _parts(df, order)
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return p.join(F.broadcast(_earlier(p, F.count(F.lit(1)))), "_part").withColumn(name, F.col("_base") + own).drop("_part", "_base")


def running_sum(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows before the row in the order."""
    p = _parts(df, order)
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return p.join(F.broadcast(_earlier(p, F.sum(value))), "_part").withColumn(name, F.col("_base") + F.coalesce(F.sum(value).over(w), F.lit(0))).drop("_part", "_base")


def with_previous(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """Adds the value of the row before in the order; null for the first row."""
    p = _parts(df, order)
    last = p.groupBy("_part").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    before = last.select("_part", F.lag("_last").over(Window.orderBy("_part")).alias("_before"))
    own = F.lag(value).over(Window.partitionBy("_part").orderBy(*order))
    first = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) == 1
    return p.join(F.broadcast(before), "_part").withColumn(name, F.when(first, F.col("_before")).otherwise(own)).drop("_part", "_before")


def joined_in_runs(rows: DataFrame, told: DataFrame, key: str, by: str) -> DataFrame:
    """Join of ``rows`` with ``told``, which has each key once, where a key may be that of very many rows.

    ``told`` first meets the distinct keys of each run of rows, then the rows of that run; runs are by a hash of ``by``.
    """
    n = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_run", F.pmod(F.xxhash64(by), F.lit(n)).cast("int"))
    return dealt.join(dealt.select("_run", key).distinct().join(told, key), ["_run", key]).drop("_run")


def sums_before(df: DataFrame, time: str, vector: str) -> DataFrame:
    """time, earlier, sums: of each distinct time, how many rows have an earlier one, and the sum of their vectors.

    Vectors are summed by time and dimension first; times are then dealt by range, and what came before a part is a sum
    over parts, so the work grows with the rows and not with their pairs.
    """
    flat = df.select(time, F.posexplode(vector).alias("_dim", "_x"))
    own = flat.groupBy(time, "_dim").agg(F.sum("_x").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = settle(own.repartitionByRange(n, time).withColumn("_part", F.spark_partition_id()), "times")
    totals = parts.groupBy("_part", "_dim").agg(F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"))
    before = Window.partitionBy("_dim").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_part", "_dim").orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    # A part may lack a dimension that earlier parts have, so every part gets every dimension.
    grid = parts.select("_part").distinct().crossJoin(parts.select("_dim").distinct()).join(totals, ["_part", "_dim"], "left")
    base = grid.select("_part", "_dim", zero("_sum", before).alias("_base"), zero("_n", before).alias("_base_n"))
    run = parts.join(base, ["_part", "_dim"]).select(time, "_dim", (F.col("_base") + zero("_sum", inside)).alias("_x"), (F.col("_base_n") + zero("_n", inside)).alias("_n"))
    lists = run.groupBy(time).agg(F.max("_n").alias("earlier"), F.array_sort(F.collect_list(F.struct("_dim", "_x"))).alias("_v"))
    return lists.select(time, "earlier", F.transform("_v", lambda s: s["_x"]).alias("sums"))


def context_before(df: DataFrame, id_col: str, time: str, vector: str) -> DataFrame:
    """id, time, earlier, context: the mean cosine of each row with all rows of an earlier time; null where there is none.

    The mean is one product with the sum of the earlier unit vectors. Rows without a time, or whose vector has no length,
    have no part. All vectors have one length.
    """
    rows = settle(df.where(F.col(time).isNotNull() & (norm(F.col(vector)) > 0)).select(id_col, time, unit(F.col(vector)).alias("_u")), "units")
    met = joined_in_runs(rows, sums_before(rows, time, "_u"), time, id_col)
    return met.select(id_col, time, "earlier", F.when(F.col("earlier") > 0, dot(F.col("_u"), F.col("sums")) / F.col("earlier")).alias("context"))
