"""Readers and writers of the file forms: paper JSON, chunk JSON, PDF listings, CSV and JSON exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAPER_SCHEMA = (
    "id string, title string, abstract string, categories array<string>, year int, "
    "pdf_content struct<markdown:string, sections:array<struct<title:string,level:int,content:string>>, images:array<struct<figure_id:string,caption:string,path:string,context:string,type:string>>, "
    "tables:array<struct<table_id:string,caption:string,markdown:string,context:string>>, equations:array<struct<eq_id:string,latex:string,context:string,type:string>>, "
    "code_blocks:array<struct<language:string,content:string,section:string>>, references:array<struct<id:string,text:string,type:string>>>, embeddings array<float>"
)
CHUNK_SCHEMA = "paper_id string, metadata struct<filename:string,path:string,extraction_timestamp:string>, chunks array<struct<text:string,start_char:int,end_char:int,chunk_id:int,embedding:array<float>>>, num_chunks int"
METADATA_SCHEMA = "arxiv_id string, title string, authors array<string>, abstract string, categories array<string>, published string, updated string, date string"


def read_papers(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """One JSON file a paper; with a limit, the first by id."""
    df = spark.read.schema(PAPER_SCHEMA).json(path, multiLine=True)
    return df if limit is None else df.orderBy("id").limit(limit)


def read_chunks(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """One JSON file a paper, one row a chunk that has an embedding."""
    df = spark.read.schema(CHUNK_SCHEMA).json(path, multiLine=True)
    if limit is not None:
        df = df.orderBy("paper_id").limit(limit)
    return df.select("paper_id", F.explode("chunks").alias("c")).where(F.coalesce(F.size("c.embedding"), F.lit(0)) > 0).select("paper_id", "c.*")


def pdf_listing(spark: SparkSession, pdf_dir: str, metadata_dir: str | None = None) -> DataFrame:
    """paper_id, path and the metadata of the JSON file of the same name, null where there is none. Contents of PDFs are not read."""
    pdfs = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(pdf_dir).select("path", F.regexp_extract("path", r"([^/]+)\.pdf$", 1).alias("paper_id"))
    if metadata_dir is None:
        return pdfs
    meta = spark.read.schema(METADATA_SCHEMA).json(metadata_dir, multiLine=True).withColumn("stem", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    return pdfs.join(meta, pdfs["paper_id"] == meta["stem"], "left").drop("stem")


def paper_records(papers: DataFrame) -> DataFrame:
    """The stored record of each paper that has contents and an embedding, with defaults and content figures."""
    n = lambda c: F.coalesce(F.size(f"pdf_content.{c}"), F.lit(0))
    full = F.col("pdf_content.markdown")
    return papers.where("pdf_content IS NOT NULL AND coalesce(size(embeddings), 0) > 0").select(
        F.translate("id", "./", "__").alias("paper_id"), F.col("id").alias("arxiv_id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("abstract", F.lit("")).alias("abstract"),
        F.coalesce("year", F.lit(2020)).alias("year"), F.coalesce("categories", F.array().cast("array<string>")).alias("categories"), F.coalesce(F.try_element_at("categories", F.lit(1)), F.lit("")).alias("primary_category"),
        F.col("embeddings").alias("embedding"), F.size("embeddings").alias("embedding_dim"), F.length(F.coalesce(full, F.lit(""))).alias("content_length"), F.substring(full, 1, 5000).alias("content_preview"),
        F.struct(F.length(F.coalesce(full, F.lit(""))).alias("markdown_length"), *[n(c).alias(f"num_{c}") for c in ("sections", "images", "tables", "equations", "code_blocks", "references")]).alias("content_stats"))


def export(df: DataFrame, path: str, order: str, limit: int | None = None, form: str = "csv") -> None:
    """The first rows by ``order`` as CSV with a header, or JSON lines."""
    out = df.orderBy(order) if limit is None else df.orderBy(order).limit(limit)
    if form not in ("csv", "json", "parquet"):
        raise ValueError(f"unknown form {form!r}")
    (out.write.mode("overwrite").option("header", True) if form == "csv" else out.write.mode("overwrite")).format(form).save(path)
