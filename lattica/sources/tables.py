"""The logical tables of the engine, taken from the stored ones. Nothing is collected; columns are pruned at the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import text as tx
from lattica.functions.vector import as_double

CHUNK_WORDS, CHUNK_OVERLAP = 64, 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have an embedding: paper_id, title, abstract, body, categories, primary_category, year, embedding (double)."""
    docs, vecs = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    return docs.join(vecs, docs["doc_id"] == vecs["vec_id"]).select(
        F.col("doc_id").alias("paper_id"), F.substring("text", 1, 60).alias("title"), F.substring("text", 61, 400).alias("abstract"), F.col("text").alias("body"),
        F.array("lang", "source").alias("categories"), F.col("lang").alias("primary_category"), (F.lit(2015) + F.col("doc_id") % 10).cast("int").alias("year"),
        as_double(F.col("embedding")).alias("embedding"), F.col("label"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, v: all embeddings."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), as_double(F.col("embedding")).alias("v"))


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, paper, chunk_index, v: embeddings as the chunks of papers of five chunks each."""
    return vectors(spark, sf_dir).select("id", F.floor(F.col("id") / 5).cast("long").alias("paper"), (F.col("id") % 5).cast("int").alias("chunk_index"), "v")


def chunks(spark: SparkSession, sf_dir: str, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """paper_id, chunk_index, chunk_id, text, tokens: word windows of all documents."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("paper_id"), F.posexplode(tx.word_windows(F.col("text"), size, overlap)).alias("chunk_index", "text")).select(
        "paper_id", "chunk_index", F.concat(F.col("paper_id").cast("string"), F.lit("_chunk_"), F.col("chunk_index").cast("string")).alias("chunk_id"), "text", tx.n_words(F.col("text")).alias("tokens"))


def implementations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper_id of labelled documents of good quality, each once."""
    return table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("paper_id")).distinct()


def dimensional_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper_id, primary_category and four scores of labelled papers; natural zeros come from the labels."""
    p = papers(spark, sf_dir).select("paper_id", "primary_category", "embedding")
    lab = table(spark, sf_dir, "labels")
    head = F.sqrt(F.aggregate(F.slice("embedding", 1, 32), F.lit(0.0), lambda s, x: s + x * x))
    return p.join(lab, p["paper_id"] == lab["doc_id"]).select(
        "paper_id", "primary_category", F.when(F.col("primary_category") == "en", 1.0).otherwise(0.3).alias("w"),
        F.least(F.lit(1.0), head).alias("h"), F.col("quality").cast("double").alias("c"), (1 - F.col("toxic")).cast("double").alias("t"))
