import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica.functions import ids, packers, sql
from lattica.functions.packers import pack_chars, pack_words
from lattica.functions import scores as sc
from lattica.functions import text as tx
from lattica.functions import vector as vec


def one(spark, col, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(col.alias("r")).first()["r"]


@pytest.mark.parametrize(("text", "kind"), [
    ("plain words", "text"), ("```x", "code"), ("import a", "mixed"), ("def class import from lambda var let x " * 3, "code"),
    ("$$", "equation"), ("see \\begin{table} and so on and so on and so on", "table"), ("Fig. 1 Fig. 2 Fig. 3 shows a plot of it all", "figure_caption"),
    ("Figure 1 and Table 2 show", "mixed"), ("costs $5 for a long enough text here", "text"), ("\\begin{figure} x", "figure_caption"),
])
def test_chunk_type(spark, text, kind):
    assert one(spark, tx.chunk_type(F.col("t")), t=text) == kind


@pytest.mark.parametrize(("text", "header"), [
    ("## Intro\nx", "Intro"), ("2.3 Methods\nx", "2.3 Methods"), ("RELATED WORK", "Related Work"), ("API", None), ("plain", None),
    ("\n\n\\section{Deep Water}\n", "Deep Water"), ("A1 B2", None), ("x" * 101 + "\n# Late", "Late"), ("\n" * 12 + "# Too late", None), ("", None),
])
def test_section_header(spark, text, header):
    assert one(spark, tx.section_header(F.col("t")), t=text) == header


def test_full_text_is_whole(spark):
    parts = [F.lit("T"), F.array(F.lit("c"), F.lit("d")), F.lit("a"), F.repeat(F.lit("word "), 120_000), F.array(F.lit("last"))]
    want = "Title: T\n\nCategories: c, d\n\nAbstract: a\n\n" + "word " * 120_000 + "\n\nReferences: last"
    assert one(spark, tx.full_text(*parts)) == want
    assert one(spark, tx.full_text(*parts, limit=9)) == want[:9]


def test_word_windows(spark):
    text = " ".join(f"w{i}" for i in range(10))
    got = one(spark, tx.word_windows(F.col("t"), 4, 1), t=text)
    assert [g.split()[0] for g in got] == ["w0", "w3", "w6", "w9"]
    assert got[-1] == "w9"
    assert one(spark, tx.word_windows(F.col("t"), 4), t="  \n ") == []
    with pytest.raises(ValueError, match="overlap"):
        tx.word_windows(F.lit("x"), 4, 4)


def test_extraction(spark):
    text = "# A\n![](p.png) and ![cap](q.png)\n```py\nx = 1\n```\n```\ny\n```"
    figures = one(spark, tx.figures(F.col("t")), t=text)
    assert [(f["figure_id"], f["caption"], f["path"]) for f in figures] == [("fig1", "Figure 1", "p.png"), ("fig2", "cap", "q.png")]
    blocks = one(spark, tx.code_blocks(F.col("t")), t=text)
    assert [(b["language"], b["content"]) for b in blocks] == [("py", "x = 1\n"), ("unknown", "y\n")]
    assert one(spark, tx.sections(F.col("t")), t="a\n## B\nc\n## D") == ["a", "B\nc", "D"]
    assert [(r["id"], r["text"]) for r in one(spark, tx.numbered(F.col("a"), "ref"), a=["x", "y"])] == [("ref1", "x"), ("ref2", "y")]


def test_primitives(spark):
    text = "The Transformer learns an embedding; optimizing by gradient. Generation of proofs"
    assert one(spark, tx.primitives(F.col("t")), t=text) == ["transformer", "embedding", "optimization"]
    assert "generation" in one(spark, tx.primitives(F.col("t"), tx.STEM_PRIMITIVES), t=text)


def test_jaccard(spark):
    a, b = tx.overlap_tokens(F.col("a")), tx.overlap_tokens(F.col("b"))
    assert one(spark, tx.jaccard(a, b), a="the deep graph model", b="a deep graph of it") == pytest.approx(2 / 3)
    assert one(spark, tx.jaccard(a, b), a="the", b="deep") == 0.0


@pytest.mark.parametrize(("paper", "date", "category", "key"), [
    ("2310.08560", "2023-10-01", "uncategorized", "2310_08560"), ("hep-th/9901001", "1999-01-01", "hep-th", "hep-th_9901001"),
    ("abc", "2020-01-01", "uncategorized", "abc"), ("math-ph1", "2020-01-01", "math", "math-ph1"), ("cs/0112017.v1", "2001-12-01", "cs", "cs_0112017_v1"),
])
def test_ids(spark, paper, date, category, key):
    got = spark.range(1).select(F.lit(paper).alias("p")).select(ids.infer_date(F.col("p")).alias("d"), ids.infer_categories(F.col("p"))[0].alias("c"), ids.safe_key(F.col("p")).alias("k")).first()
    assert tuple(got) == (date, category, key)


def test_times_and_defaults(spark):
    assert one(spark, ids.iso_time(F.col("t")).cast("string"), t="2024-05-06T07:08:09Z") == "2024-05-06 07:08:09"
    assert one(spark, ids.iso_time(F.col("t")), t="soon") is None
    assert one(spark, ids.year_of(F.col("t")), t="1999-01-01") == 1999
    assert one(spark, ids.year_of(F.col("t")), t="none") == 2020
    assert one(spark, ids.first_truthy(F.col("a"), F.col("b")), a="", b="x") == "x"


def test_vectors(spark):
    assert one(spark, vec.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[1.0, 1.0]) == pytest.approx(math.sqrt(0.5))
    assert one(spark, vec.cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 1.0]) is None
    assert one(spark, vec.unit(F.col("a")), a=[3.0, 4.0]) == pytest.approx([0.6, 0.8])
    assert one(spark, vec.usable(F.col("a")), a=[1.0, float("nan")]) is False
    assert one(spark, vec.weighted_distance(F.col("a"), F.col("b"), F.col("w")), a=[1.0, 2.0], b=[2.0, 4.0], w=[1.0, 2.0]) == pytest.approx(3.0)


@pytest.mark.parametrize(("context", "want"), [(0.5, 0.353553), (0.7, 0.585662), (0.9, 0.853815), (0.0, 0.0), (1.0, 1.0)])
def test_amplify(spark, context, want):
    assert one(spark, sc.amplify(F.col("c")), c=context) == pytest.approx(want, abs=1e-6)


def test_scores(spark):
    d = [F.col(x) for x in "abcd"]
    assert one(spark, sc.information(*d), a=0.5, b=0.8, c=0.9, d=0.7) == pytest.approx(0.252)
    assert one(spark, sc.log_information(*d), a=0.5, b=0.8, c=0.9, d=0.7) == pytest.approx(0.252)
    assert one(spark, sc.log_information(*d), a=0.0, b=0.8, c=0.9, d=0.7) == 0.0
    assert one(spark, sc.additive(*d), a=0.1, b=0.9, c=0.9, d=0.9) == pytest.approx(0.7)
    assert one(spark, sc.clamped_information(F.col("a")), a=[0.1, 10.0, 1.0, 1.0]) == pytest.approx(0.1)
    assert one(spark, sc.least_dimensions(F.lit(1e7), F.lit(0.1))) == pytest.approx(13815.51, abs=0.01)
    c = sc.conveyance(F.lit(0.5), F.lit(0.9), F.lit(0.1))
    assert one(spark, c) == pytest.approx(0.042691, abs=1e-6)
    assert one(spark, sc.actionable(c, F.lit(0.1))) == pytest.approx(0.004269, abs=1e-6)
    assert one(spark, sc.frame(F.lit(2), F.lit(1), {"x": (1.0, F.lit(1.0))})) == 0.0
    assert one(spark, sc.observed(F.lit(0), F.lit(1.0))) == 0.0
    assert one(spark, sc.survival(F.col("r")), r=[0.5, 0.5]) == 0.25
    assert one(spark, sc.half_life(F.lit(0.0))) is None
    assert one(spark, sc.persistence(F.lit(2.0), F.lit(3.0), F.col("k")), k=[1.0, 2.0]) == 3.0
    assert one(spark, sc.context_from_text(F.lit("A proof with an algorithm, results, an example and code"))) == 1.0


@settings(max_examples=30, deadline=None)
@given(st.text(alphabet="ab. \nAB#", max_size=200))
def test_packers_keep_all_words(text):
    joined = " ".join(t for t, _, _ in packers.pack_words(text, 8, 0)).replace("#", " ").split()
    assert joined == text.replace("#", " ").split()
    assert all(n <= 8 or len(t.split()) == n for t, _, n in packers.pack_words(text, 8, 0))


def test_pack_words_overlap():
    text = "One two three. Four five six. Seven eight nine. Ten."
    chunks = list(packers.pack_words(text, 6, 2))
    assert [c[0] for c in chunks] == ["One two three. Four five six.", "five six. Seven eight nine. Ten."]
    assert [c[2] for c in chunks] == [6, 6]


def test_pack_chars_places():
    text = "Aa aa aa. " * 3 + "\n\n" + "short"
    chunks = list(packers.pack_chars(text.strip(), 12))
    assert chunks[0] == ("Aa aa aa.", 0, 9)
    assert all(b - a == len(t) for t, a, b in chunks)
    assert chunks[1][0].startswith("Aa aa aa. Aa aa aa.")  # the last piece is handed on


def test_packed_chunks_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b")], "doc_id long, text string")
    assert [tuple(r) for r in packers.packed_chunks(docs).collect()] == [(3, 0, "a b", 0, 2)]
    assert [tuple(r) for r in packers.packed_chunks(docs, by="chars").collect()] == [(3, 0, "a b", 0, 3)]
    with pytest.raises(ValueError, match="packer"):
        packers.packed_chunks(docs, by="lines")


def test_functions_in_sql(spark):
    sql.register(spark)
    one = spark.sql("SELECT amplify(0.25) a, amplify(0.25, 2) b, transfer(0.5, 1, 0.25) t, information(array(0.5, 0.5)) i, information(array(0.5, null)) z, cosine(array(1, 1), array(1, 0)) c, cosine(array(0, 0), array(1, 0)) n").first()
    assert (one["a"], one["b"], one["t"], one["i"], one["z"], one["n"]) == (0.125, 0.0625, 0.09375, 0.25, 0, None)
    assert one["c"] == pytest.approx(2**-0.5)
    spark.createDataFrame([(1, "a b  c d e"), (2, None), (3, " ")], "id long, body string").createOrReplaceTempView("sql_texts")
    got = spark.sql("SELECT id, posexplode(w) AS (i, chunk) FROM (SELECT id, word_windows(body, 2, 1) AS w FROM sql_texts)")
    want = spark.table("sql_texts").select("id", F.posexplode(tx.word_windows(F.col("body"), 2, 1)).alias("i", "chunk"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_packers_in_sql(spark):
    sql.register(spark)
    text = "One two three. " * 3 + "\n\nFour five.\n## Next\n\nsix"
    spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, body string").createOrReplaceTempView("sql_texts")
    for by, target, pack in (("words", 4, pack_words), ("chars", 20, pack_chars)):
        got = spark.sql(f"SELECT id, p.* FROM sql_texts, LATERAL packed(body, '{by}', {target}) p ORDER BY id, chunk_index").collect()
        assert [tuple(r) for r in got] == [(1, i, *c) for i, c in enumerate(pack(text, target))]
