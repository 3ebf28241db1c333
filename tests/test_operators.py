from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import cluster, encode, graph, pairs, sampling, stats


@pytest.fixture(scope="module")
def vecs(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(60, 8))
    m[7] = 0
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(100, None), (101, [float(x) for x in m[3]])]
    return spark.createDataFrame(rows, "id long, v array<double>")


def test_pairs_agree(spark, vecs):
    got = {(r["src"], r["dst"]): r["sim"] for r in pairs.similar_pairs(vecs, 0.3).collect()}
    other = {(r["src"], r["dst"]): r["sim"] for r in pairs.similar_pairs_sql(vecs, 0.3).collect()}
    small = {(r["src"], r["dst"]): r["sim"] for r in pairs.similar_pairs(vecs, 0.3, block=7).collect()}
    assert got.keys() == other.keys() == small.keys()
    assert (3, 101) in got
    assert all(abs(got[k] - other[k]) < 1e-9 and abs(small[k] - got[k]) < 1e-9 for k in got)
    assert all(a < b for a, b in got)


def test_pairs_prune_blocks_exactly(spark):
    # Two tight bundles far apart: cells between them are never made, and no pair is lost.
    rng = np.random.default_rng(1)
    a = np.array([1.0, 0, 0]) + rng.normal(0, 0.05, (40, 3))
    b = np.array([-1.0, 0, 0]) + rng.normal(0, 0.05, (40, 3))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([a, b]))], "id long, v array<double>")
    assert pairs.similar_pairs(df, 0.9, block=10).count() == pairs.similar_pairs_sql(df, 0.9).count() == 2 * 40 * 39 // 2


def test_pairs_empty(spark):
    assert pairs.similar_pairs(spark.createDataFrame([], "id long, v array<double>"), 0.5).count() == 0


def test_nearest(spark, vecs):
    rows = pairs.nearest(vecs, 3, 0.0).collect()
    by = {}
    for r in rows:
        by.setdefault(r["src"], []).append((r["rank"], r["sim"]))
    assert max(len(x) for x in by.values()) == 3
    assert all(s == sorted(s, key=lambda x: (x[0], -x[1])) for s in (sorted(x) for x in by.values()))


def test_document_similarity(spark):
    sims = [0.9, 0.8, 0.7, 0.6, 0.5, 0.1]
    rows = [(s, 1 + i % 2, 2 - i % 2) for i, s in enumerate(sims)] + [(0.4, 3, 4), (0.2, 3, 4)]
    d = {r["from_paper"]: r for r in graph.document_similarity(spark.createDataFrame(rows, "sim double, from_paper long, to_paper long")).collect()}
    assert d[1]["top_k_mean"] == pytest.approx(0.70)
    assert d[3]["top_k_mean"] == pytest.approx(0.30)
    assert d[1]["mean"] <= d[1]["top_k_mean"] <= d[1]["max"]
    with pytest.raises(ValueError, match="method"):
        graph.document_edges(spark.createDataFrame(rows, "sim double, from_paper long, to_paper long"), "median", 0.1)


def test_two_hops_on_a_triangle(spark):
    e = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.5), (1, 3, 0.5)], "src long, dst long, sim double")
    seeds = spark.createDataFrame([(1,)], "paper_id long")
    got = sorted((r["other"], r["hops"]) for r in graph.neighbours(e, seeds).collect())
    assert got == [(2, 1), (2, 2), (3, 1), (3, 2)]


def test_amplified_is_idempotent(spark):
    e = spark.createDataFrame([(1, 2, 0.5)], "src long, dst long, sim double")
    once = graph.amplified(e)
    assert graph.amplified(once, 2.0).first()["context_amplified"] == once.first()["context_amplified"] == pytest.approx(0.353553, abs=1e-6)


def test_distances(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0), (3, 4, 1.0), (8, 9, 1.0)], "src long, dst long, sim double")
    got = {r["paper_id"]: r["distance"] for r in graph.distances(e, spark.createDataFrame([(1,)], "paper_id long"), 3).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 2}


def test_connected_and_dbscan(spark, vecs):
    e = spark.createDataFrame([(5, 4), (4, 3), (9, 8)], "src long, dst long")
    got = {r["id"]: r["component"] for r in cluster.connected(e, spark.createDataFrame([(i,) for i in (3, 4, 5, 8, 9, 11)], "id long")).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 8: 8, 9: 8, 11: 11}
    rows = [(r["id"], np.array(r["v"])) for r in vecs.where("v IS NOT NULL").collect()]
    m = {i: v / np.linalg.norm(v) for i, v in rows if np.linalg.norm(v) > 0}
    near = {i: {j for j in m if m[i] @ m[j] >= 0.6 - 1e-12} for i in m}
    cores = {i for i in m if len(near[i]) >= 4}
    label = {}
    for i in sorted(cores):
        if i not in label:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in label:
                    label[x] = i
                    todo += [y for y in near[x] if y in cores]
    got = {r["id"]: r["cluster"] for r in cluster.dbscan(vecs, 0.4, 4).collect()}
    assert {i: got[i] for i in cores} == label
    assert all((got[i] != -1) == bool(near[i] & cores) for i in m)


def test_samples(spark):
    df = spark.range(1000).select("id", (F.when(F.col("id") < 900, "a").otherwise("b")).alias("g"))
    a = sampling.sample(df, 100, "diverse", "id", "id", ["g"])
    assert a.count() == 100
    assert {r["g"]: r["count"] for r in a.groupBy("g").count().collect()} == {"a": 90, "b": 10}
    assert sampling.sample(df, 5000, "diverse", "id", "id", ["g"]).count() == 1000
    r1, r2 = (sorted(x["id"] for x in sampling.random_sample(d, 50, "id").collect()) for d in (df, df.repartition(7)))
    assert r1 == r2
    rare = sampling.sample(df, 100, "rare_first", "id", "id", ["g"])
    assert rare.where("g = 'b'").count() > 25
    with pytest.raises(ValueError, match="strategy"):
        sampling.sample(df, 1, "best", "id", "id", ["g"])


def test_pairs_of_string_ids_and_of_one_angle(spark):
    """Vectors whose first entries are 0, many copies of one vector, and ids that are no numbers."""
    rng = np.random.default_rng(5)
    rows = [(f"k{i:04d}", [0.0, *map(float, rng.normal(size=5))]) for i in range(150)] + [(f"z{i:04d}", [0.0, 1.0, 0.0, 0.0, 0.0, 0.0]) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, v array<double>").repartition(5)
    got = pairs.similar_pairs(df, 0.8, block=40)
    want = pairs.similar_pairs_sql(df, 0.8)
    key = lambda d: {(r["src"], r["dst"]): round(r["sim"], 9) for r in d.collect()}
    assert key(got) == key(want)
    rows, bounds = pairs._blocks(df, 40, 2)
    assert bounds.count() > 8
    assert rows.groupBy("b").count().agg(F.max("count")).first()[0] <= 2 * 40


def test_exact_percentile(spark):
    x = np.random.default_rng(1).normal(size=501)
    df = spark.createDataFrame([(float(v),) for v in [*x, *x[:50]]] + [(None,)], "v double")
    for q in (0, 0.1, 0.5, 0.77, 1):
        assert stats.percentile(df, "v", q).first()[0] == pytest.approx(np.quantile([*x, *x[:50]], q))


def test_fit_alpha(spark):
    rows = [(g, c / 50, 0.7, 0.7 * (c / 50) ** a) for g, a in (("x", 1.3), ("y", 2.2)) for c in range(1, 51)] + [("z", 0.5, 1.0, 0.5)]
    df = spark.createDataFrame(rows, "g string, c double, b double, y double")
    got = {r["g"]: r for r in stats.fit_alpha(df, "c", "b", "y", keys=["g"], least=20).collect()}
    assert got.keys() == {"x", "y"}
    assert got["x"]["alpha"] == pytest.approx(1.3, abs=1e-3)
    assert got["y"]["alpha"] == pytest.approx(2.2, abs=1e-3)
    assert got["x"]["r2"] == pytest.approx(1, abs=1e-6)
    assert stats.best_alpha(df.where("g = 'x'"), "c", "b", "y", steps=26).first()["alpha"] == pytest.approx(1.3)


def test_probabilities():
    assert stats.two_sided_p(2.0, 10) == pytest.approx(0.07338803)
    assert stats.two_sided_p(0.0, 10) == 1.0
    assert stats.chi_square_p(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert stats.chi_square_p(20.0, 3) == pytest.approx(0.000169742, abs=1e-8)


def test_auc_against_pairs(spark):
    rng = np.random.default_rng(0)
    s, f = rng.integers(0, 6, 80) / 5, rng.random(80) < 0.4
    df = spark.createDataFrame([(float(a), bool(b)) for a, b in zip(s, f, strict=True)], "s double, f boolean")
    want = np.mean([(x > y) + 0.5 * (x == y) for x in s[f] for y in s[~f]])
    assert stats.auc(df, "s", "f").first()["auc"] == pytest.approx(want)


def test_chi_square_guard(spark):
    df = spark.createDataFrame([("a", False), ("b", False)], "g string, f boolean")
    assert stats.chi_square(df, "g", "f").first()["statistic"] is None


def test_principal_components(spark, vecs):
    good = vecs.where("v IS NOT NULL")
    m = np.array([r["v"] for r in good.collect()])
    mean, comps, shares = stats.principal_components(good, "v", 2)
    cov = np.cov(m.T)
    assert np.allclose(mean, m.mean(axis=0))
    assert np.allclose(shares, np.sort(np.linalg.eigvalsh(cov))[::-1] / np.trace(cov))
    got = np.array([r["coords"] for r in stats.project(good, "v", mean, comps).collect()])
    assert np.allclose(np.sort(got, axis=0), np.sort((m - m.mean(axis=0)) @ comps, axis=0))
    assert stats.dims_for_variance(np.array([0.5, 0.4, 0.06, 0.04])) == 3


def test_density_adds_up(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in rng.normal(size=(50, 2))], "x double, y double")
    d = stats.density(df, "x", "y", 10)
    assert d.count() == 100
    assert d.agg(F.min("density")).first()[0] >= 0


def test_encoder(spark):
    df = spark.createDataFrame([(1, "deep graph"), (2, "deep graph"), (3, None)], "k long, t string")
    got = {r["id"]: r["v"] for r in encode.encode(df, "k", "t", encode.hashing_encoder(16), batch=2).collect()}
    assert got[1] == got[2]
    assert np.linalg.norm(got[1]) == pytest.approx(1)
    assert np.linalg.norm(got[3]) == 0
    assert np.allclose(encode.mean_pool(np.ones((1, 2, 3)), np.array([[1.0, 0.0]])), 1)


def test_overlapping_finds_all_pairs(spark):
    import random

    from lattica.operators import paths

    rng = random.Random(2)
    sets = [(i, rng.sample("abcdefghijklmnop", rng.randint(0, 12))) for i in range(60)]
    for x in (0.2, 0.5, 0.8):
        got = {(r["a"], r["b"]): r["jaccard"] for r in paths.overlapping(spark.createDataFrame(sets, "id long, tokens array<string>"), x).collect()}
        want = {(i, j): len(set(a) & set(b)) / len(set(a) | set(b)) for i, a in sets for j, b in sets if i < j and a and b}
        assert got == pytest.approx({k: v for k, v in want.items() if v > x})


def test_shortest_paths(spark):
    from lattica.operators import paths

    nodes = spark.createDataFrame([(1, "theory", "aa"), (2, "algorithm", "bbb"), (3, "reference", "c"), (4, "implementation", "d")], "node long, kind string, content string")
    edges = spark.createDataFrame([(1, 2, "theory", "algorithm", 0.1), (2, 3, "algorithm", "reference", 0.1), (3, 4, "reference", "implementation", 0.1), (1, 4, "theory", "implementation", 0.5)], "src long, dst long, from_kind string, to_kind string, weight double")
    got = {r["start"]: r["path"] for r in paths.shortest(edges, nodes.where("node < 4"), nodes.where("node = 4")).collect()}
    assert got == {1: [1, 2, 3, 4], 2: [2, 3, 4], 3: [3, 4]}
    q = {r["start"]: r for r in paths.qualities(paths.shortest(edges, nodes.where("node = 1"), nodes.where("node = 4")), nodes, edges).collect()}
    assert q[1]["length"] == 4
    assert q[1]["completeness"] == pytest.approx(0.8)
    assert q[1]["quality"] == pytest.approx(0.3 * 0.8 + 0.3 * 0.1 + 0.2 * 7 / 1000 + 0.2 * np.exp(-0.6))
    many = spark.createDataFrame([(["theory", "algorithm"], i % 2 == 0) for i in range(6)] + [(["theory", "reference"], True)], "kinds array<string>, ok boolean")
    assert [tuple(r) for r in paths.critical_transitions(many, "ok").collect()] == [("theory", "algorithm", 6, 0.5)]
    assert paths.sequences(many, 1).first()["n"] == 6


def test_matches_by_title(spark):
    from lattica.operators import paths

    p = spark.createDataFrame([(1, "The Deep Graph Model"), (2, "Graphs"), (3, "Absent Words Here Now"), (4, None)], "paper_id long, title string")
    i = spark.createDataFrame([(10, [3], "x"), (11, None, "code of the deep graph models"), (12, [], "on graphs and more"), (13, [9], None)], "impl_id long, references array<long>, description string")
    assert sorted(map(tuple, paths.matches(p, i).collect())) == [(1, 11), (2, 12), (3, 10)]


def test_model_statistics(spark):
    rng = np.random.default_rng(4)
    a, b = rng.random(400), rng.random(400)
    y = rng.random(400) < 1 / (1 + np.exp(-(6 * a * b - 1.5)))
    df = spark.createDataFrame([(float(p), float(q), float(p * q), bool(r)) for p, q, r in zip(a, b, y, strict=True)], "a double, b double, ab double, y boolean")
    got = stats.compare_models(df, ["a", "b"], "ab", "y")
    assert got["multiplicative_aic"] < 400 * 2 * np.log(2) + 4
    assert 0 <= got["p"] <= 1
    assert stats.f_upper_p(4.0, 2, 27) == pytest.approx(0.0300, abs=2e-4)
    assert stats.size_for_effect(0.3) == 175
    flat = spark.createDataFrame([("x", 1.0), ("x", 1.0)], "g string, v double")
    assert stats.anova(flat, "g", "v").first()["f"] is None


def test_runs(spark, tmp_path):
    from lattica.sources import runs

    path = str(tmp_path / "log")
    runs.log_run(spark, path, "r1", "load", "ok", 5, {"a": 1})
    runs.log_run(spark, path, "r1", "pairs", "failed")
    assert tuple(runs.run_summary(spark.read.schema(runs.LOG_SCHEMA).parquet(path)).first())[:4] == ("r1", 2, 1, 5)
    bad = runs.guarded(spark.range(3), {"small": "id < 2", "even": "id % 2 = 0"})
    assert [r["errors"] for r in bad.orderBy("id").collect()] == [[], ["even"], ["small"]]
    v = runs.synthetic_vectors(spark, 50, 4, 2)
    assert v.count() == 50
    assert runs.synthetic_counts(spark, 100).agg(F.min("n")).first()[0] >= 1
    f = stats.fit_alpha(runs.synthetic_alpha_points(spark, 500), "context", "base", "amplified").first()
    assert f["alpha"] == pytest.approx(1.5, abs=0.05)


def test_ordered_against_plain_windows(spark):
    from pyspark.sql import Window

    from lattica.operators import ordered

    df = spark.range(500).select("id", F.pmod(F.xxhash64("id"), F.lit(40)).alias("o"), (F.col("id") % 7).alias("v"))
    w = Window.orderBy("o", "id")
    want = df.select("id", F.row_number().over(w).alias("r"), F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("s"), F.lag("v").over(w).alias("p"))
    order = [F.col("o"), F.col("id")]
    got = ordered.ranked(df, order, "r").select("id", "r").join(ordered.running_sum(df, order, "v", "s").select("id", "s"), "id").join(ordered.with_previous(df, order, "v", "p").select("id", "p"), "id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_co_citations_do_not_depend_on_blocks(spark):
    rows = [(s, d) for s in range(4) for d in range(20) if (s + d) % 3] + [(0, 1), (9, None), (None, 3)]
    cites = spark.createDataFrame(rows, "src long, dst long")
    by = {}
    for s, d in set(rows) - {(9, None), (None, 3)}:
        by.setdefault(s, []).append(d)
    want = Counter((a, b) for l in by.values() for a in l for b in l if a < b)
    for block in (1, 4, 1024):
        assert {(r["a"], r["b"]): r["together"] for r in graph.co_citations(cites, block).collect()} == want


def test_vectors_of_the_stand_in_encoder():
    v = encode.hashing_encoder(8)(["Ab ab", "ab", "é - é", "", " "])
    assert np.allclose(v[0], v[1])
    assert np.allclose(np.linalg.norm(v, axis=1), [1, 1, 1, 0, 1])
