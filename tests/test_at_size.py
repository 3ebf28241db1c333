"""Operators whose work must not grow with the pairs they make: against plainer ways to the same rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import scores as sc
from lattica.operators import fulltext, graph, pairs, paths, stats


def vectors(spark, n=120, dims=6, seed=3):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dims))
    v[n // 2 : n // 2 + 9] = v[0]
    rows = [(i, int(i // 5) if i % 11 else 0, v[i].tolist(), int(rng.integers(0, 4)), f"t{i % 7}") for i in range(n)]
    return spark.createDataFrame([*rows, (900, 1, None, 1, "x"), (901, 1, [0.0] * dims, 1, "y")], "id long, paper long, v array<double>, year int, tag string"), v


@pytest.mark.parametrize("block", [None, 17])
def test_columns_travel_with_both_ends(spark, block):
    df, _ = vectors(spark)
    got = pairs.similar_pairs(df, 0.2, block=block, carry=["year", "tag"])
    own = df.withColumnRenamed("id", "paper_id")
    want = graph.enrich(pairs.similar_pairs_sql(df, 0.2), own.drop("paper"), ["year", "tag"])
    columns = ["src", "dst", "src_year", "dst_year", "src_tag", "dst_tag"]
    key = lambda d: sorted((*[r[c] for c in columns], round(r["sim"], 9)) for r in d.collect())
    assert key(got) == key(want)
    assert len(key(got)) > 500


def test_measures_are_of_the_vectors_themselves(spark):
    df, v = vectors(spark)
    got = pairs.similar_pairs(df, 0.2, block=17, measure=lambda x, y: np.abs(x - y).sum(axis=1)).collect()
    assert len(got) > 500
    for r in got:
        assert r["measure"] == pytest.approx(np.abs(v[r["src"]] - v[r["dst"]]).sum(), abs=1e-9)


@pytest.mark.parametrize("block", [None, 13])
def test_document_pairs_are_those_of_all_chunk_pairs(spark, block):
    df, _ = vectors(spark, 200)
    chunks = df.select("id", "paper", "v")
    got = {(r["from_paper"], r["to_paper"]): r for r in pairs.document_pairs(chunks, 0.2, block=block).collect()}
    want = graph.document_similarity(pairs.cross_paper_pairs(chunks, 0.2)).collect()
    assert len(want) == len(got) > 100
    for r in want:
        o = got[r["from_paper"], r["to_paper"]]
        assert o["num_chunk_pairs"] == r["num_chunk_pairs"]
        assert [o[c] for c in ("max", "mean", "top_k_mean")] == pytest.approx([r[c] for c in ("max", "mean", "top_k_mean")], abs=1e-9)
    assert pairs.document_pairs(chunks.limit(0), 0.2).count() == 0


def test_percentile_counts_before_it_puts_in_order(spark, monkeypatch):
    monkeypatch.setattr(stats, "FEW", 40)
    monkeypatch.setattr(stats, "COUNTED", 8)
    rng = np.random.default_rng(1)
    for x in (rng.normal(size=700), np.concatenate([np.full(300, 2.0), rng.random(150), [1e9]]), np.full(90, 3.5), np.repeat([1.0, 2.0], 60)):
        df = spark.createDataFrame([(float(a),) for a in x] + [(None,)], "v double")
        for q in (0.0, 0.25, 0.5, 0.9, 1.0):
            assert stats.percentile(df, "v", q).first()[0] == pytest.approx(np.quantile(x, q), rel=1e-12)
    assert stats.percentile(spark.createDataFrame([(None,)], "v double"), "v", 0.5).first()[0] is None


def test_inversions_of_a_function_of_the_order(spark, monkeypatch):
    monkeypatch.setattr(stats, "PACKED", 50)
    monkeypatch.setattr(stats, "EMITTED", 30)
    x = np.round(np.random.default_rng(2).normal(size=900), 2)
    df = spark.createDataFrame([(float(a),) for a in [*x, 0.0, -0.0]], "o double").repartition(5)
    value = lambda c: F.sin(c * 20)
    got = stats.inversions_of(df, "o", value, F.max("o").alias("most")).first()
    own = df.withColumn("v", value(F.col("o")))
    want = stats.inversions(own, "o", "v").first()
    assert (got["n"], got["drops"], got["most"]) == (want["n"], want["drops"], x.max())
    assert got["drops"] > 50
    empty = stats.inversions_of(df.limit(0), "o", value).first()
    assert (empty["n"], empty["drops"]) == (0, 0)


def test_points_are_drawn_where_they_are_made(spark):
    e = spark.createDataFrame([(i, i + 1, 0.2 + 0.01 * i) for i in range(60)], "src long, dst long, c double").withColumn("y", sc.amplify(F.col("c"), 1.3))
    here, dealt = (stats.bootstrap_alpha(e, "c", "y", deal=d).first() for d in (False, True))
    assert list(here) == pytest.approx(list(dealt), abs=1e-12)


def test_postings_are_gathered_where_a_document_is_read(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a  C"), (2, None), (3, ""), (4, "c")], "doc_id long, text string").coalesce(1)
    index = fulltext.Index.build(docs, str(tmp_path / "i"), "doc_id", "text")
    got = sorted((r["id"], r["n_terms"], r["term"], list(r["places"])) for r in index.postings.collect())
    assert got == [(1, 4, "a", [0, 2]), (1, 4, "b", [1]), (1, 4, "c", [3]), (4, 1, "c", [0])]
    assert (index.n, index.mean) == (4, 1.25)
    # One task read the documents; an exchange would have dealt its postings to several files of a bucket or other tasks.
    assert len({f.rsplit("/", 1)[1].split("-")[1] for f in index.postings.inputFiles()}) == 1


def test_overlapping_sets_meet_in_cells_of_like_sizes(spark, monkeypatch):
    monkeypatch.setattr(paths, "BLOCK_TOKENS", 150)
    monkeypatch.setattr(paths, "MEETINGS", 40)
    rng = random.Random(6)
    sets = [(i, i % 3, rng.sample("abcdefghijklmnop", rng.randint(0, 14))) for i in range(90)] + [(200, 0, None), (201, 1, ["x"] * 3), (202, 2, ["x"])]
    allowed = np.array([[False, True, False], [True, True, False], [False, False, False]])
    df = spark.createDataFrame(sets, "id long, kind int, tokens array<string>")
    for x in (0.12, 0.5, 0.8):
        for some in (None, allowed):
            made = paths.overlapping(df, x, some)
            got = {(r["a"], r["b"]): r["jaccard"] for r in made.collect()}
            want = {(i, j): len({*a} & {*b}) / len({*a} | {*b}) for i, k, a in sets for j, m, b in sets if i < j and a and b and (some is None or some[k, m])}
            assert got == pytest.approx({k: v for k, v in want.items() if v > x})
    assert paths.overlapping(df.limit(0), 0.5).count() == 0


def test_titles_are_found_by_runs_of_inner_words(spark):
    """A frequent word of a title no longer brings every description that holds it."""
    rng = random.Random(3)
    words = ["alpha", "Beta", "c", "", "the", "ünï", "d\ne"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(60)] + [None, ""]
    titles = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) for _ in range(80)] + [None, "", " ", "pha", "a b", "ha Be", "a  b"]
    p = spark.createDataFrame(list(enumerate(titles)), "paper_id long, title string")
    i = spark.createDataFrame([(k, [k + 50], t) for k, t in enumerate(texts)], "impl_id long, references array<long>, description string")
    want = {(a, b) for a, t in enumerate(titles) for b, d in enumerate(texts) if (t and d and t.lower() in d.lower()) or a == b + 50}
    assert sorted(map(tuple, paths.matches(p, i).collect())) == sorted(want)
    assert len(want) > 150
