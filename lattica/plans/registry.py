"""Registration of queries with the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name; ``sql`` is DuckDB's."""

    def add(fn: Query) -> Query:
        if fn.__name__ in QUERIES:
            raise ValueError(f"query {fn.__name__} is registered twice")
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


#: Common tables of the SQL side.
PAPERS = """papers AS (SELECT doc_id AS paper_id, substr(text, 1, 60) AS title, substr(text, 61, 400) AS abstract, text AS body, [lang, source] AS categories, lang AS primary_category,
  (2015 + doc_id % 10)::INTEGER AS year, embedding::DOUBLE[] AS v, label FROM documents JOIN embeddings ON doc_id = vec_id)"""
EDGE_THRESHOLD = 0.3
EDGES = f"""{PAPERS},
edges AS (SELECT a.paper_id AS src, b.paper_id AS dst, list_cosine_similarity(a.v, b.v) AS sim FROM papers a JOIN papers b ON a.paper_id < b.paper_id WHERE list_cosine_similarity(a.v, b.v) > {EDGE_THRESHOLD})"""
BOTH = EDGES + """,
both_ways AS (SELECT src, dst, sim FROM edges UNION ALL SELECT dst, src, sim FROM edges)"""
CHUNKS = """words AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: w <> '') AS w FROM documents),
chunks AS (SELECT doc_id AS paper_id, unnest(range(0, len(w), 48)) // 48 AS chunk_index, unnest(list_transform(range(0, len(w), 48), lambda i: array_to_string(w[i + 1:i + 64], ' '))) AS text FROM words)"""
SCORES = f"""{PAPERS},
scores AS (SELECT paper_id, primary_category, CASE WHEN primary_category = 'en' THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END AS w, least(1.0::DOUBLE, sqrt(list_sum(list_transform(v[1:32], lambda x: x * x)))) AS h,
  quality::DOUBLE AS c, (1 - toxic)::DOUBLE AS t FROM papers JOIN labels ON paper_id = doc_id)"""
