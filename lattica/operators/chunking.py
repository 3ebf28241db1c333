"""Chunk records of documents: windows of words with their header, kinds of content and vector."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import text as tx
from lattica.operators.encode import encode


def chunk_records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, overlap: int = 200) -> DataFrame:
    """chunk_id, doc_id, chunk_index, text, tokens, metadata (section, has_equations, has_code, has_figures, has_tables, chunk_type).

    Stored documents are chunked anew by calling this with other sizes. Null and blank texts have no chunk.
    """
    t = F.col("text")
    c = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(tx.word_windows(F.col(text_col), size, overlap)).alias("chunk_index", "text"))
    c = c.withColumns({"m": tx.has_math(t), "c": tx.has_code(t), "f": tx.has_figures(t), "b": tx.has_tables(t)})
    metadata = F.struct(
        tx.section_header(t).alias("section"), F.col("m").alias("has_equations"), F.col("c").alias("has_code"), F.col("f").alias("has_figures"), F.col("b").alias("has_tables"),
        tx.chunk_type(t, tuple(map(F.col, "mcfb"))).alias("chunk_type"))
    key = F.concat(F.col("doc_id").cast("string"), F.lit("_chunk_"), F.col("chunk_index").cast("string"))
    return c.select(key.alias("chunk_id"), "doc_id", "chunk_index", "text", tx.n_words(t).alias("tokens"), metadata.alias("metadata"))


def embedded_chunks(records: DataFrame, encoder: Callable[[list[str]], np.ndarray], batch: int = 256) -> DataFrame:
    """chunk_id, v: the vectors of chunk records; join them to the records by id. Rows stay where they are."""
    return encode(records, "chunk_id", "text", encoder, batch).withColumnRenamed("id", "chunk_id")
