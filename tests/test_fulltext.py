"""The full-text index and the mean context before a date, against loops."""

import math
import random

import numpy as np

from lattica.operators import fulltext, ordered


def words(text):
    return (text or "").lower().split()


def corpus():
    rng = random.Random(3)
    v = ["der", "die", "das", "é", "x.", "Rot", "blau"]
    texts = [" ".join(rng.choice(v) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    return [*enumerate([*texts, None, "", "a a a a", "only\there\nonce"])], [(0, "der die"), (1, "A a"), (2, "only here once"), (3, None), (4, " "), (5, "nowhere"), (6, texts[5]), (7, "das nowhere"), (8, "é")]


def test_phrases_and_ranks(spark, tmp_path):
    docs, queries = corpus()
    index = fulltext.Index.build(spark.createDataFrame(docs, "i long, t string").repartition(3), str(tmp_path / "index"), "i", "t", 4)
    q = spark.createDataFrame(queries, "k long, q string")
    want = []
    for k, text in queries:
        p = words(text)
        for i, t in docs:
            w = words(t)
            at = [s for s in range(len(w) - len(p) + 1) if w[s : s + len(p)] == p] if p else []
            want += [(k, i, len(at), at[0])] if at else []
    got = index.phrases(q, "k", "q")
    assert sorted(tuple(r) for r in got.select("query", "id", "n", "first").collect()) == sorted(want)
    n, mean = len(docs), sum(len(words(t)) for _, t in docs) / len(docs)
    ranks = []
    for k, text in queries:
        scores = []
        for i, t in docs:
            w, s = words(t), 0.0
            for term in words(text):
                df = sum(term in words(x) for _, x in docs)
                tf = w.count(term)
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean)) if tf else 0
            if set(w) & set(words(text)):
                scores.append((-round(s, 9), i))
        ranks += [(k, r, i) for r, (_, i) in enumerate(sorted(scores)[:3], 1)]
    assert sorted(tuple(r) for r in index.ranked(q, "k", "q", 3).select("query", "rank", "id").collect()) == sorted(ranks)
    # The index is opened again from its folder, and a search reads the buckets of its terms only.
    again = fulltext.Index(spark, str(tmp_path / "index"))
    assert (again.n, again.buckets) == (n, 4)
    plan = again.postings.where("bucket = 1")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_an_empty_index(spark, tmp_path):
    index = fulltext.Index.build(spark.createDataFrame([], "i long, t string"), str(tmp_path / "index"), "i", "t")
    q = spark.createDataFrame([(1, "a")], "k long, q string")
    assert index.phrases(q, "k", "q").collect() == [] == index.ranked(q, "k", "q").collect()


def test_context_before(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(0, 9)) if i % 11 else 3, rng.normal(size=4).tolist()) for i in range(200)] + [(300, None, [1.0] * 4), (301, 2, None), (302, 2, [0.0] * 4)]
    got = {r["id"]: (r["earlier"], r["context"]) for r in ordered.context_before(spark.createDataFrame(rows, "id long, t int, v array<double>"), "id", "t", "v").collect()}
    assert set(got) == set(range(200))
    for i, t, v in rows[:200]:
        near = [float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)) for _, s, w in rows[:200] if s < t]
        assert got[i][0] == len(near)
        assert got[i][1] is None if not near else math.isclose(got[i][1], sum(near) / len(near), abs_tol=1e-9)
