"""Hard negatives, lexical search and substring dedup against brute force on small fixtures."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from lattica.llm import hard_negatives, lexical, suffix_tree

#: Columns beside the keys that bear names the operators use themselves.
CLASH = "row_no long, run int, h long, c long, score double, item_no long, q long, g int"


def frame(spark, rows, schema, parts=3):
    extra = (1, 2, 3, 4, 0.5, 6, 7, 8)
    df = spark.createDataFrame([(*r, *extra) for r in rows], f"{schema}, {CLASH}")
    return df.repartition(parts) if rows else df


# --- hard negatives


def brute_mine(rows, scale=256):
    use = []
    for no, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        use.append((no, i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(scale * float(np.float32(x))) for x in v]))
    last = lambda i: (i is None, i or 0)
    out = []
    for no, i, label, q in use:
        if i is None or i % 100:
            continue
        scored = [(sum(a * b for a, b in zip(q, r, strict=False)), j, m, lab) for m, j, lab, r in use if m != no]
        scored.sort(key=lambda s: (-s[0], last(s[1])))
        for p in [s for s in scored if s[3] == label][:5]:
            good = [s for s in scored if s[3] != label and 80 * p[0] <= 100 * s[0] <= 100 * p[0]][:5]
            out += [(i, p[1], rank, s[1], p[0], s[0]) for rank, s in enumerate(good, 1)]
    return sorted(out, key=repr)


def mined(df):
    return sorted((tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=repr)


def vectors(n=900, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=6) * 0.3)], int(rng.integers(0, 3))) for i in range(n)]
    rows += [(n + i, rows[100][1], int(rng.integers(0, 3))) for i in range(60)]  # a group of equal vectors
    rows += [(2000, None, 1), (2100, [0.1] * 6, None), (2200, [0.1, None] * 3, 1), (2300, [float("nan")] * 6, 1), (2400, [float("inf")] + [0.1] * 5, 0)]
    rows += [(2500, [], 1), (2600, [0.5, 0.5], 1), (None, [0.4] * 6, 2), (2700, [-0.2] * 6, 9), (2701, [-0.1] * 6, 9), (2800, [0.0] * 6, 2)]
    return rows


def test_hard_negatives_are_those_of_brute_force(spark, monkeypatch):
    rows = vectors()
    df = frame(spark, rows, "vec_id long, embedding array<float>, label int")
    want = brute_mine(rows)
    assert len(want) > 50
    assert mined(hard_negatives.mine(df)) == want
    # Many cells on both sides, and a single pivot.
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    monkeypatch.setattr(hard_negatives, "CELL_BYTES", 100 * (8 * (6 + hard_negatives.PIVOTS) + 64))
    assert mined(hard_negatives.mine(df, pivots=1)) == want


def test_hard_negatives_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert hard_negatives.mine(frame(spark, [], schema)).collect() == []
    assert hard_negatives.mine(frame(spark, [(100, None, 1), (200, [1.0], None)], schema)).collect() == []
    # Repeated rows are rows of their own; an anchor is no positive of itself but its copy is.
    twice = [(100, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (3, [0.9, 0.0], 2)]
    assert mined(hard_negatives.mine(frame(spark, twice, schema))) == [(100, 100, 1, 3, 65536, 58880)] * 2
    # Products beyond 53 bits are exact, and those beyond 64 bits are null.
    large = [(100, [2.0**30, 1.0], 1), (101, [2.0**30, 3.0], 1), (102, [2.0**30, 2.0], 2), (103, [2.0**30, 4.0], 2)]
    assert mined(hard_negatives.mine(frame(spark, large, schema))) == [(100, 101, 1, 102, None, None)]
    big = [(100, [2.0**22, 1.0], 1), (101, [2.0**22, 3.0], 1), (102, [2.0**22, 2.0], 2), (103, [2.0**22, 4.0], 2)]
    assert mined(hard_negatives.mine(frame(spark, big, schema))) == [(100, 101, 1, 102, 2**60 + 3 * 2**16, 2**60 + 2 * 2**16)]
    huge = [(100, [1e38, 1.0], 1), (101, [1e38, 3.0], 1), (102, [1e38, 2.0], 2)]
    assert [r[:4] for r in mined(hard_negatives.mine(frame(spark, huge, schema)))] == [(100, 101, 1, 102)]


def test_pivot_brackets_hold_the_scores_and_drop_rows():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    x = np.floor((rng.normal(size=(10, 4)) * 5)[rng.integers(0, 10, 300)] * 100 + rng.normal(size=(300, 4)) * 5)
    longest = float((x * x).sum(axis=1).max())
    lifted = hard_negatives.Table._lift(x, longest)
    pivots = hard_negatives.farthest_first(lifted, 16)
    far = np.sqrt(((lifted[:, None, :] - pivots[None]) ** 2).sum(axis=2))
    t = pa.table({"side": [0] * 20 + [1] * 280, "row_no": list(range(300)), "vec_id": list(range(300)), "label": [1] * 300, "q": x.tolist(), "far": far.tolist()})
    c = hard_negatives.Cell(t, 4, longest, pivots)
    low, high = c.bracket(np.arange(20), np.arange(280))
    s = x[:20] @ x[20:].T
    assert (low <= s).all() and (s <= high).all()
    fifth = np.sort(low, axis=1)[:, -5]
    assert (high < fifth[:, None]).mean() > 0.5


# --- lexical search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, k=10):
    each = [(i, collections.Counter(terms(t)), len(terms(t))) for i, t in docs]
    some, total = sum(n > 0 for _, _, n in each), sum(n for _, _, n in each)
    df = collections.Counter(t for _, c, _ in each for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in each:
            score = 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * some + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * (25 + 75 * n * some // total)))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def searched(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def texts(seed=2, n=120):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abéßĀ9") for _ in range(rng.randint(1, 4))) for _ in range(80)]
    word = lambda: vocabulary[min(79, int(rng.expovariate(0.08)))]
    out = [rng.choice([" ", ", ", "_"]).join(word().upper() if rng.random() < 0.2 else word() for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return out + [out[3]] * 15 + [None, "", " ,;\n", "x" * 5000, " ".join(word() for _ in range(9000))], [" ".join(word() for _ in range(rng.randint(1, 30))) for _ in range(12)]


@pytest.mark.parametrize(("shard_rows", "shard_bytes", "block_terms"), [(4096, 1 << 22, 1 << 19), (7, 1 << 22, 10), (4096, 600, 1)])
def test_lexical_search_is_that_of_brute_force(spark, shard_rows, shard_bytes, block_terms):
    bodies, asked = texts()
    docs = [(i * 3 % 143 if i != 50 else None, t) for i, t in enumerate(bodies)] + [(7, bodies[4]), (7, bodies[4])]
    items = [*enumerate(asked), (3, "b b B b"), (20, None), (21, ""), (22, "nowhere-to-be-found"), (None, asked[0])]
    got = lexical.search(frame(spark, docs, "doc_id long, text string", 5), frame(spark, items, "item_id long, text string"), block_terms=block_terms, shard_rows=shard_rows, shard_bytes=shard_bytes)
    want = brute_search(docs, items)
    assert len(want) > 100
    assert searched(got) == want


def test_shards_are_stored_as_bytes_and_few_are_read_at_once(spark):
    """A reader holds a group of a file at a time; lists of numbers cost the executors many times their bytes."""
    docs = frame(spark, [(i, f"word{i % 7} word{i} other") for i in range(90)], "doc_id long, text string", 1)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, "4")
    try:
        index, some = lexical.build_index(docs, shard_rows=4, shard_bytes=1 << 20)
    finally:
        spark.conf.set(key, was)
    assert some == 90
    assert {f.dataType.simpleString() for f in index.schema.fields[1:]} == {"binary"}
    groups = [m.row_group(g).num_rows for f in index.inputFiles() for m in [pq.ParquetFile(f.removeprefix("file://")).metadata] for g in range(m.num_row_groups)]
    assert sum(groups) >= 20
    assert max(groups) <= lexical.STORED_TOGETHER


def test_lexical_search_of_odd_tables(spark):
    docs, items = "doc_id string, text string", "item_id string, text string"
    assert searched(lexical.search(frame(spark, [], docs), frame(spark, [("a", "x")], items))) == []
    assert searched(lexical.search(frame(spark, [("a", "x")], docs), frame(spark, [], items))) == []
    assert searched(lexical.search(frame(spark, [("a", None), ("b", "--")], docs), frame(spark, [("a", "x")], items))) == []
    got = searched(lexical.search(frame(spark, [("b", "x y"), ("a", "x y"), ("c", "z"), ("d", "z")], docs), frame(spark, [("i", "X")], items)))
    assert [r[:3] for r in got] == [("i", 1, "a"), ("i", 2, "b")]


def test_selection_keeps_all_ties_in_order():
    scores = np.array([0, 5, 7, 5, 5, 9, 0, 5], np.int64)
    assert lexical.select(scores, 3).tolist() == [5, 2, 1]
    assert lexical.select(scores, 20).tolist() == [5, 2, 1, 3, 4, 7]
    assert lexical.select(scores * 0, 3).tolist() == []


# --- substring dedup


def brute_substrings(rows, size):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    count = collections.Counter(tuple(w[s : s + size]) for _, w in split for s in range(len(w) - size + 1))
    out = []
    for i, w in split:
        gone = {x for s in range(len(w) - size + 1) if count[tuple(w[s : s + size])] > 1 for x in range(s, s + size)}
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return sorted(out, key=repr)


def passages(seed=4, n=60):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcé") + rng.choice("xyz") * rng.randint(0, 2)
    shared = [[word() for _ in range(40)] for _ in range(4)]
    out = []
    for i in range(n):
        own = [word() for _ in range(rng.randint(0, 80))]
        for s in rng.sample(shared, rng.randint(0, 2)):
            a, b = sorted((rng.randint(0, 40), rng.randint(0, 40)))
            at = rng.randint(0, len(own))
            own[at:at] = s[a:b] if i % 3 else s
        out.append(rng.choice([" ", "\n", " \t "]).join(own))
    return out + [out[0], out[0], out[1].replace(" ", "\x0b"), out[2] + " tail", "head " + out[2], None, "", " \n", "na " * 200, "na " * 90, "one word", ("w " * 9).strip(), " ".join(out[5].split()[:12])]


@pytest.mark.parametrize(("size", "k", "meet"), [(12, 5, 1024), (12, 5, 3), (12, 12, 2), (35, 8, 1024), (35, 8, 2), (9, 1, 4)])
def test_substring_dedup_is_that_of_brute_force(spark, size, k, meet):
    rows = [*enumerate(passages()), (3, passages()[3]), (None, passages()[4])]
    df = frame(spark, rows, "doc_id long, text string", 4)
    got = suffix_tree.substring_dedup(df, size=size, k=k, meet=meet).select("doc_id", "n_words", "n_removed", "kept_sha256")
    want = brute_substrings(rows, size)
    assert sum(r[2] for r in want) > 500
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_substring_dedup_of_long_texts_in_blocks(spark, monkeypatch):
    rng = random.Random(9)
    long = [str(rng.randint(0, 10**6)) for _ in range(3000)]
    rows = [(0, " ".join(long + long[100:200])), (1, " ".join(long[1500:1600])), (2, "x"), (3, " ".join(long[2980:]))]
    monkeypatch.setattr(suffix_tree, "BLOCK", 64)
    got = suffix_tree.substring_dedup(frame(spark, rows, "doc_id long, text string", 2), size=35)
    assert sorted(tuple(r)[:4] for r in got.collect()) == brute_substrings(rows, 35)
    blocked = suffix_tree.anchors(np.arange(500, dtype=np.uint64), 35, 8)
    assert blocked[1].sum() == 500 - 34


def test_substring_dedup_of_odd_tables(spark):
    assert suffix_tree.substring_dedup(frame(spark, [], "doc_id long, text string")).collect() == []
    got = suffix_tree.substring_dedup(frame(spark, [("a", None), ("b", "x y")], "doc_id string, text string"), with_text=True).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_removed"], bytes(r["kept"])) for r in got] == [(0, 0, b""), (2, 0, b"x y")]
    with pytest.raises(ValueError):
        suffix_tree.substring_dedup(frame(spark, [], "doc_id long, text string"), size=80)


def test_trees_keep_no_leaf_alone():
    group = np.array([1, 1, 1, 2])
    right = np.array([[1, 2, 3], [1, 2, 4], [1, 5, 6], [1, 2, 3]], np.uint64)
    levels = suffix_tree.tree_nodes(group, right, np.array([3, 3, 2, 3]))
    assert [len({x for x in level.tolist() if x >= 0}) for level in levels] == [2, 1, 1, 0]
    assert levels[2].tolist()[:2] == [0, 0] and levels[2][2] == -1
