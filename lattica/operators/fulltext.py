"""A full-text index: stored positional posting lists, phrase search and ranking.

A posting is a term, a document, the document's length, and the places where the term stands. Postings are stored by
bucket of the term's hash, so that a search reads the buckets of its terms only; the lengths of documents lie beside them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions import text as tx
from lattica.sources.scratch import bound_batches, settle

BUCKETS = 32
#: The usual constants of the ranking: how soon repeats stop counting, and how much length does.
K1, B = 1.2, 0.75


def terms(text: Column) -> Column:
    """Terms of a text, in order: lower-cased words between white space; none of a null text."""
    return tx.words(F.lower(F.coalesce(text, F.lit(""))))


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, n_terms, term, places: a row for each term of each document (id, t), places in order."""
    for b in batches:
        ids, lists = b.column(0), b.column(1)
        n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        words = lists.flatten().dictionary_encode()
        doc, term = np.repeat(np.arange(len(n)), n), words.indices.to_numpy(zero_copy_only=False)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        order = np.lexsort((at, term, doc))
        doc, term, at = doc[order], term[order], at[order]
        first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])]))
        places = pa.ListArray.from_arrays(pa.array(np.append(first, len(doc)).astype(np.int32)), pa.array(at.astype(np.int32)))
        of = doc[first]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(of)), pa.array(n[of]), words.dictionary.take(pa.array(term[first])), places], ["id", "n_terms", "term", "places"])


class Index:
    """An index in a folder: ``postings`` (term, id, n_terms, places; parted by bucket) and ``lengths`` (id, n_terms)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.lengths = spark.read.parquet(f"{path}/lengths")
        kind = self.lengths.schema["id"].dataType.simpleString()
        self.postings = spark.read.schema(f"id {kind}, n_terms long, term string, places array<int>, bucket int").parquet(f"{path}/postings")
        row = self.lengths.agg(F.count(F.lit(1)), F.sum("n_terms"), F.max("buckets")).first()
        self.n, self.mean, self.buckets = row[0], (row[1] or 0) / max(1, row[0]), row[2] or BUCKETS

    @classmethod
    def build(cls, docs: DataFrame, path: str, id_col: str, text_col: str, buckets: int = BUCKETS) -> Index:
        """Indexes all texts and stores the index. Ids are unique; documents without a term count as such of length 0."""
        split = docs.select(F.col(id_col).alias("id"), terms(F.col(text_col)).alias("t"))
        split.select("id", F.size("t").cast("long").alias("n_terms"), F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{path}/lengths")
        # The places of a term in a document are gathered where the document is read, and stored from there.
        bound_batches(docs.sparkSession)
        kind = split.schema["id"].dataType.simpleString()
        lists = split.where(F.size("t") > 0).mapInArrow(_postings, f"id {kind}, n_terms long, term string, places array<int>")
        lists.withColumn("bucket", _bucket(F.col("term"), buckets)).write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings")
        return cls(docs.sparkSession, path)

    def asked(self, queries: DataFrame, query_col: str, text_col: str) -> DataFrame:
        """query, term, at, m, bucket: the terms of each query (each place a row) and how many it has."""
        t = queries.select(F.col(query_col).alias("query"), terms(F.col(text_col)).alias("t"))
        return t.select("query", F.size("t").alias("m"), F.posexplode("t").alias("at", "term")).withColumn("bucket", _bucket(F.col("term"), self.buckets))

    def _wanted(self, asked: DataFrame, places: Column) -> DataFrame:
        """The postings of the terms that are asked for, read once, with their places or what is needed of them; the scan skips buckets without such a term."""
        own = self.postings.join(asked.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi")
        return settle(own.select("id", "n_terms", "term", places), "wanted-postings")

    def phrases(self, queries: DataFrame, query_col: str, text_col: str) -> DataFrame:
        """query, id, n, first: documents that hold the whole query in a row, how often, and at which term (from 0).

        Documents of the query's rarest term are the candidates; the places of its other terms are then looked up by term
        and document, so that frequent terms are met only in candidates. Queries without a term find nothing.
        """
        asked = settle(self.asked(queries, query_col, text_col), "asked")
        wanted = self._wanted(asked, F.col("places"))
        df = wanted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        rare = asked.join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
        rarest = rare.groupBy("query").agg(F.min_by("term", F.struct("df", "at")).alias("term"))
        candidates = rarest.join(wanted.select("term", "id"), "term").select("query", "id")
        needed = candidates.join(asked.select("query", "term", "at", "m"), "query")
        found = needed.join(wanted.select("term", "id", "places"), ["term", "id"]).select("query", "id", "m", F.transform("places", lambda p: p - F.col("at")).alias("starts"))
        lists = found.groupBy("query", "id", "m").agg(F.collect_list("starts").alias("all")).where(F.size("all") == F.col("m"))
        common = F.aggregate(F.slice("all", 2, F.greatest(F.lit(1), F.size("all"))), F.get("all", F.lit(0)), F.array_intersect)
        return lists.select("query", "id", common.alias("starts")).where(F.size("starts") > 0).select("query", "id", F.size("starts").cast("long").alias("n"), F.array_min("starts").cast("long").alias("first"))

    def ranked(self, queries: DataFrame, query_col: str, text_col: str, k: int = 10) -> DataFrame:
        """query, rank, id, score: the k documents that fit each query best, by how rare and how frequent its terms are and how long the document is; ties by id. Repeated terms of a query count again."""
        asked = self.asked(queries, query_col, text_col).groupBy("query", "bucket", "term").agg(F.count(F.lit(1)).alias("times"))
        asked = settle(asked, "asked")
        wanted = self._wanted(asked, F.size("places").cast("double").alias("tf"))
        df = wanted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        idf = F.log(1 + (F.lit(self.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weights = asked.join(df, "term").select("query", "term", (idf * F.col("times")).alias("w"))
        tf = F.col("tf")
        part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n_terms") / F.lit(float(self.mean or 1))))
        scores = weights.join(wanted.select("term", "id", part.alias("part")), "term").groupBy("query", "id").agg(F.sum(F.col("w") * F.col("part")).alias("score"))
        w = Window.partitionBy("query").orderBy(F.round("score", 9).desc(), "id")
        return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "rank", "id", "score")
