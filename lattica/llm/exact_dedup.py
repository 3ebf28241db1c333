"""Exact dedup by a tree merge of sorted digest runs.

Every scan partition turns its rows into a run of (digest, smallest row, count), sorted by digest. Runs are cut into
shards by digest prefix, so that no task ever holds a whole level. Rounds of a fan-in of ``FAN_IN`` (three binomial
rounds at once) then exchange the runs of a shard and merge them; each level keeps, of equal digests, the smallest
identifier and the summed count. Digests count as equal only if a second, independent hash and the length agree too.
A group of copies is at most one row per run and level. The answer goes back the same way, to the runs and then to
each run's rows, so a hot group never meets in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import by_run, drop_scratch, materialize, n_partitions, numbered, of_numbers

FAN_IN = 8


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest_rows(docs: DataFrame, id_col: str, text_col: str, number: Column) -> DataFrame:
    """One row per input row: id, row number, run number, digest and its check."""
    text = normalised(F.col(text_col))
    return docs.select(F.col(id_col).alias("doc_id"), number.alias("row_no"), text.alias("t")).select(
        "doc_id", "row_no", F.spark_partition_id().alias("run"), F.sha2("t", 256).alias("text_sha256"), F.struct(F.xxhash64("t").alias("x"), F.octet_length("t").alias("n")).alias("check")
    )


def merge_round(runs: DataFrame, partitions: int) -> DataFrame:
    """Merges each group of ``FAN_IN`` runs of a shard: one exchange, a sort by digest, a streaming reduction."""
    dealt = runs.withColumn("run", F.floor(F.col("run") / FAN_IN).cast("int")).repartition(partitions, "shard", "run").sortWithinPartitions("shard", "run", "text_sha256", "check")
    return dealt.groupBy("shard", "run", "text_sha256", "check").agg(F.min("least").alias("least"), F.sum("group_size").alias("group_size"))


def _groups(docs: DataFrame, id_col: str, text_col: str, number: Column) -> tuple[DataFrame, DataFrame]:
    """Digest rows, and one row per digest: the row that stays and the group's size."""
    spark = docs.sparkSession
    rows = materialize(digest_rows(docs, id_col, text_col, number), "digests")
    source_runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    n = n_partitions(spark)
    shard = F.pmod(F.conv(F.substring("text_sha256", 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int")
    least = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_no")
    # Level 0: each scan partition reduces its own rows before anything is exchanged.
    runs = rows.groupBy(shard.alias("shard"), "run", "text_sha256", "check").agg(F.min(least).alias("least"), F.count(F.lit(1)).alias("group_size"))
    for _ in range(max(1, math.ceil(math.log(source_runs, FAN_IN) - 1e-9))):
        runs = merge_round(runs, n)
    return rows, runs.select("text_sha256", "check", "least", "group_size")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all columns: of equal texts one, by the rules of ``exact_dedup``.

    Ids may be of any type that has an order; columns may have any names. An empty table gives an empty result.
    """
    rows, number = numbered(docs)
    digests, merged = _groups(rows, id_col, text_col, F.col(number))
    chosen = materialize(merged.select("least.row_no"), "stay")
    drop_scratch(digests)
    return of_numbers(rows, number, chosen)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per input row.

    Null text counts as empty; texts are equal when identical after each white-space run became one space. Of equal
    texts the row with the smallest id stays (a null id is larger than any; of repeated rows with that id one stays).
    A very long text is one row like others. An empty table gives an empty result; other columns are ignored.
    """
    rows, merged = _groups(docs, id_col, text_col, F.monotonically_increasing_id())
    return by_run(rows, merged, ["text_sha256", "check"]).select("doc_id", F.col("least.doc_id").alias("keep_id"), "group_size", (F.col("row_no") == F.col("least.row_no")).alias("kept"), "text_sha256")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
