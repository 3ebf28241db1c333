"""Writes: merges by key, versioned tables that change together, deletes and updates by rewriting, resuming."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def once(rows: DataFrame, keys: list[str], order: list[str] | None = None, last: bool = False) -> DataFrame:
    """One row of each key: the first (or last) in the order of the given columns, then of all columns. Rows without a key stay.

    Spark limits the rows of a key before it exchanges them, so a key with very many is no hot one.
    """
    by = [F.col(c) for c in (order or [])] + [F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))]
    w = Window.partitionBy(*keys).orderBy(*[c.desc() if last else c.asc() for c in by])
    whole = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    kept = rows.where(whole).withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")
    return kept.unionByName(rows.where(~whole))


def merge(old: DataFrame, new: DataFrame, key: str | list[str], on_duplicate: str = "replace", order: list[str] | None = None) -> DataFrame:
    """``old`` with ``new`` put in. Of rows of a key that both have, ``ignore`` keeps the old, ``replace`` the new, ``update`` the new one's values where they are not null.

    Where a key repeats in ``new``, rows come in the order of the given columns, then of all: ``ignore`` takes the first,
    the other modes the last, so that each key that was there once is there once.
    """
    keys = [key] if isinstance(key, str) else key
    if on_duplicate not in ("ignore", "replace", "update"):
        raise ValueError(f"unknown mode {on_duplicate!r}")
    new = once(new, keys, order, last=on_duplicate != "ignore")
    if on_duplicate == "ignore":
        return old.unionByName(new.join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)
    if on_duplicate == "replace":
        return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)
    a, b = old.alias("a"), new.alias("b")
    cols = [F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) if c in new.columns else F.col(f"a.{c}") for c in old.columns]
    same = reduce(Column.__and__, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys])
    return a.join(b, same, "full").select(*cols)


def merge_counts(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """inserted, duplicates, errors (rows without a key), total: one row. Of rows that repeat a new key, the first is inserted and the others are duplicates."""
    keys = new.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    seen = keys.join(old.select(F.col(key).alias("_k")).distinct(), F.col("_key") == F.col("_k"), "left")
    fresh = F.col("_key").isNotNull() & F.col("_k").isNull()
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return seen.agg(F.count_if(fresh).alias("inserted"), count(F.when(F.col("_k").isNotNull(), F.col("_n")).when(fresh, F.col("_n") - 1)).alias("duplicates"), count(F.when(F.col("_key").isNull(), F.col("_n"))).alias("errors"), count("_n").alias("total"))


def delete(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is not true."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def pending(df: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the processed ones."""
    return df.join(processed.select(key), key, "left_anti")


class VersionedStore:
    """Tables that change together: each commit writes new versions and then one manifest; readers follow the latest manifest.

    There is one writer. A commit that fails before its manifest leaves the store as it was.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _latest(self) -> tuple[int, dict[str, str]]:
        folder = self._path(f"{self.root}/_manifests")
        if not self._fs.exists(folder):
            return 0, {}
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
        if not names:
            return 0, {}
        text = self.spark.read.text(f"{self.root}/_manifests/{names[-1]}", wholetext=True).first()[0]
        return int(names[-1][:-5]), json.loads(text)

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self._latest()[1][table])

    def tables(self) -> list[str]:
        return sorted(self._latest()[1])

    def commit(self, changes: dict[str, DataFrame]) -> int:
        """Writes all tables of ``changes`` and makes them current at once; returns the version."""
        version, current = self._latest()
        for name, df in changes.items():
            path = f"{self.root}/{name}/{uuid.uuid4().hex}"
            df.write.parquet(path)
            current[name] = path
        done = self._path(f"{self.root}/_manifests/{version + 1:012d}.json")
        part = self._path(f"{self.root}/_manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(part)
        out.write(bytearray(json.dumps(current).encode()))
        out.close()
        if not self._fs.rename(part, done):
            raise OSError(f"version {version + 1} of {self.root} exists")
        return version + 1

    def upsert(self, incoming: dict[str, DataFrame], key: str) -> int:
        """Replaces, in all tables at once, every row of the keys that come in."""
        ids = next(iter(incoming.values())).select(key)
        for df in list(incoming.values())[1:]:
            ids = ids.union(df.select(key))
        ids = ids.distinct()
        have = self._latest()[1]
        return self.commit({n: self.read(n).join(ids, key, "left_anti").unionByName(df, allowMissingColumns=True) if n in have else df for n, df in incoming.items()})

    def remove(self, table: str, condition: Column) -> int:
        return self.commit({table: delete(self.read(table), condition)})


def create_database(spark: SparkSession, name: str, tables: dict[str, str], views: dict[str, str] | None = None) -> None:
    """A database with empty tables of the given schemas, and temporary views by their SQL."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}")
    for t, schema in tables.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name}.{t} ({schema}) USING parquet")
    for v, sql in (views or {}).items():
        spark.sql(sql).createOrReplaceTempView(v)


def drop_database(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")


def execute(spark: SparkSession, sql: str, args: dict | None = None, **frames: DataFrame) -> DataFrame:
    """SQL with named parameters; ``frames`` are known in it as {name}."""
    return spark.sql(sql, args=args or {}, **frames)
