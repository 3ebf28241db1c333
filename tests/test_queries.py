"""Every query of the engine's own operators against its SQL, on the smallest tables."""

import datetime
import hashlib
import math

import duckdb
import numpy as np
import pytest

from lattica.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.8g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(columns, data):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, con, name):
    df = catalog.queries()[name](spark, sf_dir)
    got = df.collect()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, got) == rows(want.columns, want.fetchall())


def test_section_headers_of_texts_with_empty_lines(spark, tmp_path):
    texts = [("# Introduction\n\nbody", "Introduction"), ("# TITLE", "TITLE"), ("\n\\section{Deep Water}\n\nbody", "Deep Water"), ("2.3 Methods\n\nx", "2.3 Methods"), ("plain\n\ntext", None), ("RELATED WORK\n# Next", "Next"), ("", None), (None, None)]
    spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.queries()["section_headers"](spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [r["header"] for r in got] == [h for _, h in texts]
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = c.sql(f"SELECT header FROM ({catalog.oracle_sql()['section_headers']}) ORDER BY doc_id").fetchall()
    assert [h for _, h in texts] == [h for h, in want]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())


def small_tables(spark, at, seed=5):
    """Documents with vectors, copies and scaled copies among them, and orders of a few lines; and DuckDB's views of them."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(60, 8)).astype(np.float32)
    v[40:55] = v[0]
    v[55:] = 2 * v[1]
    spark.createDataFrame([(i, x.tolist(), i % 10) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    spark.createDataFrame([(i, f"text {i}", "en", "web") for i in range(60)], "doc_id long, text string, lang string, source string").write.parquet(f"{at}/documents.parquet")
    lines = [(i % 40, float(rng.integers(0, 11)) / 100, float(rng.integers(0, 9)) / 100) for i in range(120)]
    spark.createDataFrame(lines, "l_orderkey long, l_discount double, l_tax double").write.parquet(f"{at}/lineitem.parquet")
    c = duckdb.connect()
    for t in ("embeddings", "documents", "lineitem"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet/*.parquet'")
    return v.astype(float), lines, c


def test_alpha_log_ratio_takes_all_edges_and_all_orders(spark, tmp_path):
    v, lines, c = small_tables(spark, tmp_path)
    df = catalog.queries()["alpha_log_ratio"](spark, str(tmp_path))
    got = {r["points"]: r for r in df.collect()}
    cos = np.array([a @ b / math.sqrt((a @ a) * (b @ b)) for i, a in enumerate(v) for b in v[i + 1 :]])
    assert got["edges"]["n"] == np.count_nonzero((cos > 0.3) & (cos < 1 - 1e-9))
    assert (got["edges"]["alpha"], got["edges"]["sd"]) == (1.5, 0)
    assert 0 < got["orders"]["n"] <= 40
    want = c.sql(catalog.oracle_sql()["alpha_log_ratio"])
    assert rows(df.columns, got.values()) == rows(want.columns, want.fetchall())


def test_alpha_bootstrap_draws_all_edges_and_all_orders_two_hundred_times(spark, tmp_path):
    v, lines, c = small_tables(spark, tmp_path)
    df = catalog.queries()["alpha_bootstrap"](spark, str(tmp_path))
    got = {r["points"]: r for r in df.collect()}
    kept = {}
    for k, d, t in lines:
        kept.setdefault(k, []).append((1 - d, (1 - d) * (1 - t / 4)))
    means = {k: np.mean(x, axis=0) for k, x in kept.items()}
    cuts = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(7)])
    draw = lambda k, i: np.count_nonzero(int(hashlib.md5(f"42:{k}:0:{i}".encode()).hexdigest()[:13], 16) / 2**52 > cuts)
    r = {k: math.log(y) / math.log(x) for k, (x, y) in means.items() if x != 1}
    m = [np.average(list(r.values()), weights=[draw(k, i) for k in r]) for i in range(1, 201)]
    assert [got["orders"][x] for x in ("low", "alpha", "high")] == pytest.approx(np.percentile(m, [2.5, 50, 97.5]), abs=2e-6)
    assert [got["edges"][x] for x in ("low", "alpha", "high")] == [1.5, 1.5, 1.5]
    want = c.sql(catalog.oracle_sql()["alpha_bootstrap"])
    assert rows(df.columns, got.values()) == rows(want.columns, want.fetchall())


def test_alpha_bootstrap_of_few_points(spark, tmp_path):
    """A single point is not drawn in some rounds; no point has no percentiles."""
    spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>").selectExpr("*", "1 AS label").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, "text", "en", "web") for i in (1, 2)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, 0.1, 0.04)], "l_orderkey long, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = catalog.queries()["alpha_bootstrap"](spark, str(tmp_path))
    c = duckdb.connect()
    for t in ("embeddings", "documents", "lineitem"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = c.sql(catalog.oracle_sql()["alpha_bootstrap"])
    got = df.collect()
    assert {r["points"]: r["low"] for r in got} == {"edges": None, "orders": pytest.approx(math.log(0.9 * 0.99) / math.log(0.9), abs=1e-6)}
    assert rows(df.columns, got) == rows(want.columns, want.fetchall())
