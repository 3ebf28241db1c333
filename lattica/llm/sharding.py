"""Sharding by extendible hashing, with DataFrame functions only.

A directory is indexed by the leading bits of a hash. Buckets start as one; a bucket that is larger than the limit
splits on its next bit, and only such a bucket does, until every shard fits. The splits of ``STEP`` bits are worked
out together from one histogram of prefixes; only rows of buckets that are still too large enter the next histogram.
Bits of the id come first. A bucket whose rows all have one id (a hot key) splits on bits of the row number after
those. A single row above the limit is a shard of its own, marked ``oversized``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import drop_scratch, fresh, materialize, numbered

STEP, BITS = 8, 60
LIMIT = 64 << 20


def hash_bits(value: Column) -> Column:
    """60 leading bits of an MD5, as a non-negative long."""
    return F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(h: Column, depth: Column | int) -> Column:
    return F.call_function("shiftright", h, F.lit(BITS) - (depth if isinstance(depth, Column) else F.lit(depth)))


def _split(rows: DataFrame, h: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """Rows with depth, prefix and figures of their shard; and the rows of buckets in which all hashes are equal, but which are too large."""
    done, left, low = [], rows, 0
    base = ["outer"]
    stuck = []
    while low < BITS:
        high = min(BITS, low + STEP)
        cells = left.groupBy(*base, _prefix(F.col(h), high).alias("cell")).agg(
            F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n"), F.min(h).alias("lo"), F.max(h).alias("hi"))
        depths = F.sequence(F.lit(low if low == 0 else low + 1), F.lit(high))
        at = cells.select(*base, "cell", "b", "n", "lo", "hi", F.explode(depths).alias("depth")).withColumn("prefix", F.call_function("shiftright", F.col("cell"), F.lit(high) - F.col("depth")))
        buckets = at.groupBy(*base, "depth", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        # The shallowest bucket of a cell that fits, or that no further bit can divide, is its shard.
        ends = buckets.where((F.col("shard_bytes") <= limit) | (F.col("lo") == F.col("hi")))
        cell_of = at.select(*base, "cell", "depth", "prefix").join(ends, [*base, "depth", "prefix"]).groupBy(*base, "cell").agg(
            F.min(F.struct("depth", "prefix", "shard_bytes", "shard_docs", (F.col("lo") == F.col("hi")).alias("one_key"))).alias("s"))
        dealt = materialize(left.withColumn("cell", _prefix(F.col(h), high)).join(cell_of, [*base, "cell"], "left").drop("cell"), "dealt")
        fits = F.col("s").isNotNull() & ((F.col("s.shard_bytes") <= limit) | (F.col("s.shard_docs") == 1))
        done.append(dealt.where(fits))
        stuck.append(dealt.where(F.col("s").isNotNull() & ~fits))
        left, low = dealt.where(F.col("s").isNull()).drop("s"), high
        if left.isEmpty():
            break
    return reduce(DataFrame.unionByName, done), reduce(DataFrame.unionByName, stuck)


def shard(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", row: Column | None = None) -> DataFrame:
    """doc_id, row_no, n_bytes, shard, depth, shard_bytes, shard_docs, oversized: one row per input row.

    ``shard`` spells the bits ('' is the whole table); bits of row numbers follow a '/'. ``row`` numbers the rows; rows
    that share both id and number stay together. Null text has 0 bytes, a null id hashes as ''. A text above the limit
    is a shard of its own. An empty table gives an empty result; other columns are ignored.
    """
    number = F.monotonically_increasing_id() if row is None else row
    read = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), hash_bits(F.col(id_col)).alias("h"), number.alias("row_no"))
    rows = materialize(read.select("*", hash_bits(F.col("row_no")).alias("h2"), F.lit("").alias("outer")), "hashed")
    spelled = lambda: F.when(F.col("s.depth") == 0, "").otherwise(F.lpad(F.bin("s.prefix"), F.col("s.depth"), F.lit("0")))
    done, stuck = _split(rows, "h", limit)
    first = done.withColumn("shard", spelled())
    if not stuck.isEmpty():
        again, alike = _split(stuck.withColumn("outer", F.concat(spelled(), F.lit("/"))).drop("s"), "h2", limit)
        first = first.unionByName(again.unionByName(alike).withColumn("shard", F.concat("outer", spelled())))
    return first.select(
        "doc_id", "row_no", "n_bytes", "shard", F.length(F.regexp_replace("shard", "/", "")).alias("depth"),
        F.col("s.shard_bytes").alias("shard_bytes"), F.col("s.shard_docs").alias("shard_docs"), (F.col("s.shard_bytes") > limit).alias("oversized"),
    )


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Writes the rows, with all columns, one folder per shard, and gives the name of the folders' column.

    That is ``shard``, with underscores before it where the rows have such a column. 'b' before the bits keeps readers
    from taking them as numbers. Each shard is at most ``limit`` bytes of text, or one row, so one task can hold it.
    Null ids and texts, repeated rows and any column names are kept as they are; an empty table writes no folder.
    """
    rows, number = numbered(docs)
    name = fresh(docs, "shard")
    plan = shard(rows, limit, id_col, text_col, F.col(number)).select(F.col("row_no").alias(number), F.concat(F.lit("b"), "shard").alias(name))
    rows.join(plan, number).drop(number).repartition(F.col(name)).write.partitionBy(name).parquet(path)
    drop_scratch(rows)
    return name


def oracle(limit: int, key: str = "doc_id", row: str | None = None) -> str:
    """SQL for rows of ``documents`` dealt by ``key``; keys that no bit divides go on by the bits of ``row``, where one is given."""
    bits = lambda c: f"('0x' || substr(md5(coalesce({c}::VARCHAR, '')), 1, 15))::BIGINT"

    def split(name: str, rows: str, h: str) -> str:
        """The shallowest bucket of each row that fits or that no bit divides."""
        return f"""
{name}_b AS (SELECT outside, depth, {h} >> ({BITS} - depth) AS prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs, min({h}) = max({h}) AS alike FROM {rows}, levels GROUP BY ALL),
{name}_m AS (SELECT r.doc_id, r.key, r.n_bytes, r.h, r.h2, r.outside, min(b.depth) AS depth FROM {rows} r JOIN {name}_b b ON r.outside = b.outside AND r.{h} >> ({BITS} - b.depth) = b.prefix WHERE b.shard_bytes <= {limit} OR b.alike GROUP BY ALL),
{name} AS (SELECT m.*, m.outside || CASE WHEN m.depth = 0 THEN '' ELSE substr(lpad(bin(m.{h}), {BITS}, '0'), 1, m.depth::INT) END AS shard, b.shard_bytes, b.shard_docs
  FROM {name}_m m JOIN {name}_b b ON m.outside = b.outside AND b.depth = m.depth AND b.prefix = m.{h} >> ({BITS} - m.depth))"""

    big = f"shard_bytes > {limit} AND shard_docs > 1"
    columns = f"{'doc_id' if row is None else f'doc_id, key AS {key}'}, n_bytes, shard, length(replace(shard, '/', ''))::INTEGER AS depth, shard_bytes, shard_docs, shard_bytes > {limit} AS oversized"
    return f"""
WITH levels AS (SELECT unnest(generate_series(0, {BITS})) AS depth),
d AS (SELECT doc_id, {key} AS key, coalesce(strlen(text), 0)::BIGINT AS n_bytes, {bits(key)} AS h, {bits(row or "doc_id")} AS h2, '' AS outside FROM documents),
{split("one", "d", "h")},
again AS (SELECT doc_id, key, n_bytes, h, h2, shard || '/' AS outside FROM one WHERE {big}),
{split("two", "again", "h2")}
SELECT {columns} FROM one WHERE NOT ({big}) UNION ALL SELECT {columns} FROM two
"""


ORACLE_SQL = oracle(LIMIT)
