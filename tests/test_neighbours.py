"""Pair joins and nearest neighbours: blocks, rounds and the inverted file."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import pairs

VECTOR = "id long, v array<double>"


def brute(rows, k, threshold):
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and any(v)}
    out = []
    for i, a in unit.items():
        near = sorted((-round(float(a @ b), 12), j) for j, b in unit.items() if j != i and float(a @ b) >= threshold)
        out += [(i, j, rank) for rank, (_, j) in enumerate(near[:k], 1)]
    return sorted(out)


def clustered(n=400, dims=5, seed=1, spread=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    return [(i, (centres[i % 12] + spread * rng.normal(size=dims)).tolist()) for i in range(n)]


@pytest.mark.parametrize(("block", "first_round", "threshold"), [(4096, 8, 0.3), (40, 1, 0.3), (40, 1, 0.97), (30, 2, -1.0), (25, 4, 0.9)])
def test_nearest_in_rounds_is_that_of_brute_force(spark, block, first_round, threshold):
    rows = clustered() + [(1000, None), (1001, []), (1002, [0.0] * 5), (1003, [1e-3, 0.0, 0.0, 0.0, 0.0])]
    got = pairs.nearest(spark.createDataFrame(rows, VECTOR), 6, threshold, block, first_round)
    assert sorted((r["src"], r["dst"], r["rank"]) for r in got.collect()) == brute(rows, 6, threshold)


def test_nearest_of_ties_and_small_tables(spark):
    same = [(i, [1.0, 2.0]) for i in range(30)] + [(30, [-1.0, 0.0])]
    got = pairs.nearest(spark.createDataFrame(same, VECTOR), 3, 0.5, 4, 1)
    assert sorted((r["src"], r["dst"], r["rank"]) for r in got.collect()) == brute(same, 3, 0.5)
    assert pairs.nearest(spark.createDataFrame([], VECTOR), 3, 0.5).collect() == []
    assert pairs.nearest(spark.createDataFrame([(1, [1.0])], VECTOR), 3, 0.5).collect() == []
    texts = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.0, 1.0])], "id string, v array<double>")
    assert [tuple(r)[:2] for r in pairs.nearest(texts, 1, 0.5).orderBy("src").collect()] == [("a", "b"), ("b", "a")]


def test_no_cell_writes_more_than_k_rows_a_vector(spark):
    rows = [(i, [1.0, i / 1e6, 1.0]) for i in range(300)]
    kernel = pairs._best_of_cell(4, -1.0)
    import pyarrow as pa

    cell = pa.table({"side": [0] * 150 + [1] * 150, "id": [i for i, _ in rows], "u": [v for _, v in rows]})
    assert len(kernel((0, 1), cell)) == 300 * 4


def test_later_rounds_leave_out_cells(spark, monkeypatch):
    made = []
    real = pairs._sides
    monkeypatch.setattr(pairs, "_sides", lambda rows, cells: (made.append(cells.count()), real(rows, cells))[1])
    rows = [(i, [math.cos(i / 100 + i * i * 1e-6), math.sin(i / 100 + i * i * 1e-6), 0.01]) for i in range(300)]
    got = pairs.nearest(spark.createDataFrame(rows, VECTOR), 2, 0.2, 10, 1)
    assert sorted((r["src"], r["dst"], r["rank"]) for r in got.collect()) == brute(rows, 2, 0.2)
    assert sum(made[2:]) < sum(made) / 4


def test_blocks_of_many_vectors_stay_within_twice_their_size(spark):
    v = F.array(*[F.randn(i) for i in range(3)])
    rows, bounds = pairs._blocks(spark.range(500_000).select("id", F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))).otherwise(v).alias("v")), 4096, 4)
    sizes = [r["m"] for r in bounds.collect()]
    assert sum(sizes) == 500_000 and max(sizes) <= 2 * 4096


def test_inverted_file_finds_most_neighbours(spark, sf_dir):
    rows = clustered(1200, 8, 2, 0.3)
    want = set(brute(rows, 5, 0.2))
    df = spark.createDataFrame(rows, VECTOR)
    got = {(r["src"], r["dst"], r["rank"]) for r in pairs.nearest_indexed(df, 5, 0.2, lists=30, probes=6).collect()}
    assert len({x[:2] for x in got} & {x[:2] for x in want}) >= 0.9 * len(want)
    # All lists asked, with lists cut into parts, is exact.
    every = pairs.nearest_indexed(df, 5, 0.2, lists=7, probes=7, block=100)
    assert {(r["src"], r["dst"], r["rank"]) for r in every.collect()} == want
    # The given vectors, which have no clusters, at the default number of lists asked.
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    exact = {tuple(r) for r in pairs.nearest(v, 10, 0.2).select("src", "dst").collect()}
    found = {tuple(r) for r in pairs.nearest_indexed(v, 10, 0.2).select("src", "dst").collect()}
    assert len(exact & found) >= 0.9 * len(exact)
    some = pairs.nearest_indexed(df, 5, 0.2, lists=30, probes=30, asked=df.where("id % 100 = 0"))
    assert {(r["src"], r["dst"], r["rank"]) for r in some.collect()} == {x for x in want if x[0] % 100 == 0}
