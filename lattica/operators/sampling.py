"""Samples of rows that come out the same whatever the partitions are: order is by hash of the id and a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _draw(key: str, seed: int) -> Column:
    """52 bits of an MD5 of seed and key, which any engine can work out."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), 1, 13), 16, 10).cast("long")


def random_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(_draw(key, seed), key).limit(n)


def sequential_sample(df: DataFrame, n: int, order: str, key: str) -> DataFrame:
    return df.orderBy(order, key).limit(n)


def quotas(df: DataFrame, n: int, group: list[str]) -> DataFrame:
    """group, size, quota: max(1, floor(n * share)), at most the size."""
    total = df.agg(F.count(F.lit(1)).alias("t"))
    by = df.groupBy(*group).agg(F.count(F.lit(1)).alias("size")).crossJoin(F.broadcast(total))
    return by.select(*group, "size", F.least("size", F.greatest(F.lit(1), F.floor(F.lit(n) * F.col("size") / F.col("t")))).cast("long").alias("quota"))


def diverse_sample(df: DataFrame, n: int, group: list[str], key: str, seed: int = 42) -> DataFrame:
    """About n rows spread over groups by their share, then cut or filled to exactly n (all rows if there are no more).

    A group's rows are ranked by a window that keeps only its quota's worth of them; rows over quota only serve to fill.
    """
    w = Window.partitionBy(*group).orderBy(_draw(key, seed), key)
    ranked = df.join(quotas(df, n, group), group).withColumn("rank", F.row_number().over(w))
    return ranked.orderBy((F.col("rank") > F.col("quota")).cast("int"), _draw(key, seed + 1), key).limit(n).select(*df.columns)


def rare_first_sample(df: DataFrame, n: int, group: list[str], key: str, seed: int = 42) -> DataFrame:
    """n rows, drawn with weights that fall with the size of their group, without replacement: the n smallest exponential clocks."""
    size = df.groupBy(*group).agg(F.count(F.lit(1)).alias("size"))
    u = (_draw(key, seed) + 1) / float((1 << 52) + 1)
    return df.join(size, group).orderBy(-F.ln(u) * F.col("size"), key).limit(n).select(*df.columns)


def sample(df: DataFrame, n: int, strategy: str, key: str, order: str, group: list[str], seed: int = 42) -> DataFrame:
    """By strategy: random, sequential, diverse or rare_first."""
    if strategy == "random":
        return random_sample(df, n, key, seed)
    if strategy == "sequential":
        return sequential_sample(df, n, order, key)
    if strategy == "diverse":
        return diverse_sample(df, n, group, key, seed)
    if strategy == "rare_first":
        return rare_first_sample(df, n, group, key, seed)
    raise ValueError(f"unknown strategy {strategy!r}")
