"""Figures of runs, encoders that fail, papers as a data source, merges with repeated keys, tables stored as folders."""

import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import text as tx
from lattica.operators import encode
from lattica.plans import catalog
from lattica.sources import json_source, store
from lattica.streaming import ingest, metrics


def test_observed_write(spark, tmp_path):
    df = spark.range(100).withColumn("x", F.when(F.col("id") % 10 > 0, F.col("id")))
    got = metrics.observed_write(df, str(tmp_path / "out"), "r", {"rows": F.count(F.lit(1)), "known": F.count("x"), "none": F.max(F.lit(None).cast("int"))})
    assert {r["measure"]: r["value"] for r in got.collect()} == {"rows": 100, "known": 90, "none": None}
    metrics.record(got, str(tmp_path / "runs"))
    metrics.record(got, str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 6 and spark.read.parquet(str(tmp_path / "out")).count() == 100


def test_rates_of_streams(spark, tmp_path):
    spark.range(50).write.parquet(str(tmp_path / "in"))
    rates = metrics.Rates()
    spark.streams.addListener(rates)
    try:
        q = ingest.read_stream(spark, str(tmp_path / "in"), "id long").writeStream.queryName("counted").format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(rates)
    assert rates.flush(spark, str(tmp_path / "rates")) >= 1
    rows = spark.read.parquet(str(tmp_path / "rates")).collect()
    assert {r["query"] for r in rows} == {"counted"} and sum(r["rows"] for r in rows) == 50
    assert rates.flush(spark, str(tmp_path / "rates")) == 0


def test_encoders_that_fail_by_size_and_by_time():
    calls, waits = [], []

    def encoder(texts):
        calls.append(len(texts))
        if len(texts) > 3:
            raise MemoryError
        if len(calls) in (4, 5):
            raise OSError("busy")
        return np.array([[len(t), 1.0] for t in texts])

    texts = ["x" * i for i in range(10)]
    assert encode.steadily(encoder, texts, sleep=waits.append)[:, 0].tolist() == list(range(10))
    assert waits == [1.0, 2.0] and max(calls) == 10
    with pytest.raises(OSError):
        encode.steadily(lambda t: (_ for _ in ()).throw(OSError()), texts, sleep=lambda s: None)
    with pytest.raises(MemoryError):
        encode.steadily(lambda t: (_ for _ in ()).throw(MemoryError()), texts)


def test_encode_halves_on_the_workers(spark):
    def small(texts):
        if len(texts) > 2:
            raise MemoryError
        return np.array([[float(len(t))] for t in texts])

    df = spark.createDataFrame([(i, "x" * i) for i in range(40)] + [(40, None)], "id long, t string")
    assert {r["id"]: r["v"] for r in encode.encode(df, "id", "t", small).collect()} == {i: [float(i % 40)] for i in range(41)}


def test_papers_as_a_source(spark, tmp_path):
    for i in range(20):
        doc = {"id": f"a/{i}", "paper_id": f"a/{i}", "title": f"T{i}", "year": 2000 + i, "categories": ["x"], "pdf_content": {"markdown": "m" * i} if i % 2 else None, "embeddings": [i, 0.5], "chunks": [{"chunk_id": k, "text": "t", "start_char": 0, "end_char": 1, "embedding": [k] if k else None} for k in range(3)]}
        (tmp_path / f"a_{i}.json").write_text(json.dumps(doc))
    (tmp_path / "other.txt").write_text("no")
    json_source.register(spark)
    read = lambda **o: spark.read.format("paper_json").options(**o).load(str(tmp_path))
    rows = {r["id"]: r for r in read().collect()}
    assert len(rows) == 20 and rows["a/3"]["markdown"] == "mmm" and rows["a/4"]["markdown"] is None and rows["a/7"]["embedding"] == [7.0, 0.5]
    assert read(partBytes="400").rdd.getNumPartitions() > 3
    chunks = read(kind="chunks")
    assert chunks.count() == 40 and chunks.where("paper_id = 'a/5'").count() == 2
    # Files of other papers are not opened: a broken one does no harm.
    (tmp_path / "a_99.json").write_text("{broken")
    assert [r["title"] for r in read().where("id = 'a/3'").collect()] == ["T3"]
    assert sorted(r["title"] for r in read().where(F.col("id").isin("a/3", "a/11")).collect()) == ["T11", "T3"]
    reader = json_source.PaperReader({"path": str(tmp_path)})
    list(reader.pushFilters([json_source.EqualTo(("id",), "a/3")]))
    assert [p.paths for p in reader.partitions()] == [[str(tmp_path / "a_3.json")]]
    with pytest.raises(Exception, match="broken|JSON|Expecting"):
        read().collect()


def test_merges_with_repeated_keys(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k long, x string, t int")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 1), (3, "e", 1), (3, "f", 2), (3, None, 3), (None, "g", 1), (None, "h", 1)], "k long, x string, t int")
    rows = lambda mode: sorted(((r["k"], r["x"]) for r in store.merge(old, new, "k", mode, ["t"]).collect()), key=repr)
    assert rows("ignore") == sorted([(1, "a"), (2, "b"), (3, "e"), (None, "g"), (None, "h")], key=repr)
    assert rows("replace") == sorted([(1, "a"), (2, "c"), (3, None), (None, "g"), (None, "h")], key=repr)
    assert rows("update") == sorted([(1, "a"), (2, "c"), (3, None), (None, "g"), (None, "h")], key=repr)
    assert store.merge_counts(old, new, "k").first().asDict() == {"inserted": 1, "duplicates": 4, "errors": 2, "total": 7}


def test_streams_of_a_table_in_a_folder(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet'")
    got = catalog.queries()["stream_daily_metrics"](spark, str(tmp_path))
    assert sum(r["n"] for r in got.collect()) == con.sql("SELECT count(*) FROM events").fetchall()[0][0]
    events.limit(0).write.mode("overwrite").parquet(str(tmp_path / "none/events.parquet"))
    assert catalog.queries()["stream_daily_metrics"](spark, str(tmp_path / "none")).collect() == []


def test_primitives_in_one_pass(spark):
    texts = ["Deep learning with self-attention and a vector space.", "multi-head attention mechanism", "spaces learnings", "An optimiz method, bert-like", "", None, "loss function; LAYER\nrun-time runtime"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    slow = F.array_compact(F.array(*[F.when(F.lower("t").rlike(p), F.lit(n)) for n, p in tx.PRIMITIVES.items()]))
    for r in df.select(tx.primitives(F.col("t")).alias("a"), slow.alias("b")).collect():
        assert r["a"] == r["b"]
