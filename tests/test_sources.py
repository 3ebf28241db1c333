import json

import pytest
from pyspark.sql import functions as F

from lattica.functions.text import word_windows
from lattica.sources import files, store
from lattica.streaming import ingest


def test_readers(spark, tmp_path):
    papers, chunks, pdfs, meta = (tmp_path / n for n in ("papers", "chunks", "pdfs", "meta"))
    for p in (papers, chunks, pdfs, meta):
        p.mkdir()
    (papers / "b.json").write_text(json.dumps({"id": "cs/01.2", "title": "B", "categories": ["x", "y"], "pdf_content": {"markdown": "m" * 9, "sections": [{"title": "s", "level": 1, "content": "c"}]}, "embeddings": [1.0]}, indent=1))
    (papers / "a.json").write_text(json.dumps({"id": "a", "title": None}))
    (chunks / "p_chunks.json").write_text(json.dumps({"paper_id": "p", "chunks": [{"text": "t", "embedding": [1.0]}, {"text": "u", "embedding": []}, {"text": "v"}]}))
    (pdfs / "q.pdf").write_bytes(b"%PDF")
    (pdfs / "r.pdf").write_bytes(b"%PDF")
    (meta / "q.json").write_text(json.dumps({"arxiv_id": "q", "title": "Q"}))
    got = files.read_papers(spark, str(papers))
    assert got.count() == 2
    assert [r["id"] for r in files.read_papers(spark, str(papers), 1).collect()] == ["a"]
    rec = files.paper_records(got).collect()
    assert len(rec) == 1
    assert rec[0]["paper_id"] == "cs_01_2"
    assert rec[0]["year"] == 2020
    assert rec[0]["content_stats"]["num_sections"] == 1
    assert [r["text"] for r in files.read_chunks(spark, str(chunks)).collect()] == ["t"]
    assert {r["paper_id"]: r["title"] for r in files.pdf_listing(spark, str(pdfs), str(meta)).collect()} == {"q": "Q", "r": None}


def test_export(spark, tmp_path):
    for form in ("csv", "json", "parquet"):
        files.export(spark.range(10), str(tmp_path / form), "id", 3, form)
        assert spark.read.format(form).option("header", True).load(str(tmp_path / form)).count() == 3
    with pytest.raises(ValueError, match="form"):
        files.export(spark.range(1), str(tmp_path / "x"), "id", form="xml")


def test_merge_modes(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k long, x string, y int")
    new = spark.createDataFrame([(2, None), (3, "c")], "k long, x string")
    rows = lambda mode: sorted((r["k"], r["x"], r["y"]) for r in store.merge(old, new, "k", mode).collect())
    assert rows("ignore") == [(1, "a", 1), (2, "b", 2), (3, "c", None)]
    assert rows("replace") == [(1, "a", 1), (2, None, None), (3, "c", None)]
    assert rows("update") == [(1, "a", 1), (2, "b", 2), (3, "c", None)]
    by_two = store.merge(old, spark.createDataFrame([(2, "b", 9), (2, "z", 8)], "k long, x string, y int"), ["k", "x"])
    assert sorted(map(tuple, by_two.collect())) == [(1, "a", 1), (2, "b", 9), (2, "z", 8)]
    with pytest.raises(ValueError, match="mode"):
        store.merge(old, new, "k", "upsert")
    assert tuple(store.merge_counts(old, new, "k").first()) == (1, 1, 0, 2)


def test_versioned_store(spark, tmp_path):
    s = store.VersionedStore(spark, f"file://{tmp_path}/db")
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert s.upsert({"documents": docs, "chunks": docs}, "doc_id") == 1
    again = spark.createDataFrame([(2, "B")], "doc_id long, text string")
    none = again.where("false")
    assert s.upsert({"documents": again, "chunks": none}, "doc_id") == 2
    assert sorted(map(tuple, s.read("documents").collect())) == [(1, "a"), (2, "B")]
    assert sorted(map(tuple, s.read("chunks").collect())) == [(1, "a")]
    s.upsert({"documents": again, "chunks": none}, "doc_id")
    assert s.read("documents").count() == 2
    s.remove("documents", F.col("text") == "B")
    assert s.read("documents").count() == 1
    assert s.tables() == ["chunks", "documents"]


def test_failed_commit_changes_nothing(spark, tmp_path):
    s = store.VersionedStore(spark, f"file://{tmp_path}/db")
    s.commit({"t": spark.range(3)})
    bad = spark.range(3).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    with pytest.raises(Exception):  # noqa: B017
        s.commit({"u": spark.range(2), "t": bad})
    assert s.read("t").count() == 3
    assert s.tables() == ["t"]


def test_database(spark):
    store.create_database(spark, "lat_test", {"papers": "id long, title string"}, {"lat_view": "SELECT 1 AS one"})
    assert spark.table("lat_test.papers").count() == 0
    assert spark.table("lat_view").first()["one"] == 1
    store.drop_database(spark, "lat_test")
    assert not spark.catalog.databaseExists("lat_test")


def test_stream_ingestion_is_idempotent(spark, tmp_path):
    src = str(tmp_path / "in")
    docs = spark.createDataFrame([(1, "a b c"), (2, "d"), (2, "d")], "doc_id long, text string")
    docs.write.parquet(src)
    s = store.VersionedStore(spark, f"file://{tmp_path}/db")
    for state in ("one", "two"):  # a lost checkpoint reads all again
        ingest.ingest(ingest.read_stream(spark, src, "doc_id long, text string"), s, str(tmp_path / state), 2, 0).awaitTermination()
        assert s.read("documents").count() == 2
        assert sorted((r["doc_id"], r["text"]) for r in s.read("chunks").collect()) == [(1, "a b"), (1, "c"), (2, "d")]


def test_windows_join_to_the_text(spark):
    text = " ".join(f"w{i}" for i in range(23))
    got = spark.range(1).select(F.array_join(word_windows(F.lit(text), 5), " ").alias("t")).first()["t"]
    assert got == text
