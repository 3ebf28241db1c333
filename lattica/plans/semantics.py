"""Queries whose rules are fixed tables of English words, over all documents and a small table of such texts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import scores as sc
from lattica.functions import text as tx
from lattica.operators import graph as g
from lattica.operators import stats as st
from lattica.plans.graph import edges, r6
from lattica.plans.textual import DBSCAN, dbscan_clusters
from lattica.plans.registry import EDGES, SCORES, query
from lattica.sources import tables as tb
from lattica.sources.scratch import shared_folder
from lattica.sources.store import VersionedStore

# The given documents are in invented languages, so the rules' own words are met in these texts.
TEXTS = [
    "A Framework for Attention. The transformer uses multi-head attention and a matrix of embeddings in vector space.",
    "Implementation of Gradient Descent. SGD and Adam optimize a loss function; training shows convergence.",
    "Bayesian Model Analysis. The likelihood and the distribution give a probability estimate, with a proof of the theorem.",
    "A Case Study. We classify documents by their representation; the algorithm has low complexity and good runtime.",
    "Deep Learning Theory. Each neuron in a layer is a projection of the dimension; deep learning needs training.",
    "Application of Text Generation. Models generate, create and produce text; they predict and forecast.",
    "RELATED WORK AND METHODS\nThe encoder and the decoder share an embedding.",
    "A plain note about nothing in particular, without any of the terms.",
    "Matrix methods. Tensor multiplication is an approach to computational efficiency; the lemma holds.",
    "Study of Optimization. An optimiz stem, generat stem, synthesis and classification; self-attention once more.",
]


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


VALUES = ", ".join(f"({i}, {quoted(t)})" for i, t in enumerate(TEXTS))
#: All documents and the texts above, under negative ids, on either side.
ALL_SQL = f"alltexts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT -1 - i, t FROM (VALUES {VALUES}) v(i, t))"
HELD_SQL = ", ".join(f"CASE WHEN regexp_matches(lower(text), {quoted(p)}) THEN {quoted(n)} END" for n, p in sorted(tx.PRIMITIVES.items()))
FOUND_SQL = f"{ALL_SQL}, fo AS (SELECT doc_id, text, list_filter([{HELD_SQL}], lambda x: x IS NOT NULL) AS ps FROM alltexts)"


def all_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    return tb.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).unionByName(own)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and the sorted names of the primitives in each text."""
    return all_texts(spark, sf_dir).select("doc_id", F.array_sort(tx.primitives(F.col("text"))).alias("ps"))


@query(f"WITH {FOUND_SQL} SELECT p AS primitive, count(*) AS n, round(count(*) / (SELECT count(*) FROM fo)::DOUBLE, 6) AS per_text FROM (SELECT unnest(ps) AS p FROM fo) GROUP BY 1")
def semantic_primitives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts hold each of the fifteen primitives; flags are summed in one pass."""
    one = found(spark, sf_dir).agg(F.count(F.lit(1)).alias("all"), *[F.count_if(F.array_contains("ps", n)).alias(n) for n in tx.PRIMITIVES])
    rows = F.inline(F.array(*[F.struct(F.lit(n).alias("primitive"), F.col(n).alias("n")) for n in tx.PRIMITIVES]))
    return one.select("all", rows).where("n > 0").select("primitive", "n", F.round(F.col("n") / F.col("all"), 6).alias("per_text"))


@query(f"WITH {FOUND_SQL} SELECT array_to_string(ps, '+') AS combination, count(*) AS n FROM fo WHERE len(ps) > 1 GROUP BY 1 ORDER BY n DESC, combination LIMIT 20")
def semantic_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty commonest sets of primitives."""
    f = found(spark, sf_dir).where(F.size("ps") > 1)
    return f.groupBy(F.array_join("ps", "+").alias("combination")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "combination").limit(20)


@query(f"""WITH {FOUND_SQL}, t AS (SELECT array_to_string(ps, '+') AS c, any_value(ps) AS ps, count(*) AS n FROM fo WHERE len(ps) > 1 GROUP BY 1 ORDER BY n DESC, c LIMIT 20)
SELECT a, b, sum(n)::BIGINT AS n FROM (SELECT n, a, unnest(ps) AS b FROM (SELECT n, ps, unnest(ps) AS a FROM t)) WHERE a <> b GROUP BY 1, 2""")
def semantic_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of primitives within the commonest sets; the diagonal is left out."""
    top = semantic_combinations(spark, sf_dir).select("n", F.split("combination", r"\+").alias("ps"))
    return top.select("n", "ps", F.explode("ps").alias("a")).select("n", "a", F.explode("ps").alias("b")).where("a <> b").groupBy("a", "b").agg(F.sum("n").alias("n"))


@query(f"""WITH RECURSIVE {DBSCAN}, {FOUND_SQL}, x AS (SELECT coalesce(cluster, -1) AS cluster, unnest(ps) AS p FROM fo LEFT JOIN db ON db.id = doc_id), k AS (SELECT cluster, p, count(*) AS n FROM x GROUP BY 1, 2),
t AS (SELECT cluster, sum(n) AS t FROM k GROUP BY 1 ORDER BY t DESC, cluster LIMIT 10), names AS (SELECT unnest([{", ".join(quoted(n) for n in tx.PRIMITIVES)}]) AS p)
SELECT t.cluster, names.p AS primitive, round(coalesce(n, 0) / (t + 1e-10), 6) AS share FROM t CROSS JOIN names LEFT JOIN k ON k.cluster = t.cluster AND k.p = names.p""")
def semantic_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of primitives in the ten clusters, by density of their vectors, with most of them; -1 are texts in none."""
    f = found(spark, sf_dir).join(dbscan_clusters(spark, sf_dir).withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1)))
    by = f.groupBy("cluster").agg(*[F.count_if(F.array_contains("ps", n)).alias(n) for n in tx.PRIMITIVES]).withColumn("t", sum((F.col(n) for n in tx.PRIMITIVES), F.lit(0)))
    top = by.where("t > 0").orderBy(F.desc("t"), "cluster").limit(10)
    return top.select("cluster", "t", F.inline(F.array(*[F.struct(F.lit(n).alias("primitive"), F.col(n).alias("n")) for n in tx.PRIMITIVES]))).select("cluster", "primitive", F.round(F.col("n") / (F.col("t") + 1e-10), 6).alias("share"))


_ANY = lambda words: " OR ".join(f"contains(lower(title), '{w}')" for w in words)


@query(f"""WITH {ALL_SQL}, f AS (SELECT doc_id, {_ANY(tx.THEORY_WORDS)} AS theory, {_ANY(tx.PRACTICE_WORDS)} AS practice FROM (SELECT doc_id, split_part(text, '.', 1) AS title FROM alltexts)),
e AS (SELECT -1 - i AS src, -1 - j AS dst, 0.5 + 0.01 * i AS sim FROM range(0, {len(TEXTS)}) a(i), range(0, {len(TEXTS)}) b(j) WHERE i < j)
SELECT src, dst, round(sim, 6)::DOUBLE AS sim FROM e JOIN f a ON a.doc_id = src JOIN f b ON b.doc_id = dst WHERE (a.theory AND b.practice) OR (b.theory AND a.practice)""")
def title_word_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between titles (first sentences) of theory and of practice, by the fixed words, over a small literal graph."""
    titles = all_texts(spark, sf_dir).select(F.col("doc_id").alias("paper_id"), F.split_part(F.col("text"), F.lit("."), F.lit(1)).alias("title"))
    n = len(TEXTS)
    e = spark.createDataFrame([(-1 - i, -1 - j, round(0.5 + 0.01 * i, 6)) for i in range(n) for j in range(i + 1, n)], "src long, dst long, sim double")
    t = F.col("title")
    return g.bridges(e, tx.mentions(t, tx.THEORY_WORDS), tx.mentions(t, tx.PRACTICE_WORDS), titles).select("src", "dst", r6("sim"))


GROUND_SQL = " + ".join(f"CASE WHEN {' OR '.join(f'contains(lower(body), {s!r})' for s in sc.GROUNDING_SIGNS[n])} THEN {p}.0::DOUBLE ELSE 0 END" for n, p in sc.GROUNDING.items())


@query(f"""WITH {EDGES}, gr AS (SELECT paper_id, ({GROUND_SQL}) / 200 AS g FROM papers),
t AS (SELECT src, dst, sim, (a.g + b.g) / 2 * pow(sim, 1.5) AS transfer FROM edges JOIN gr a ON a.paper_id = src JOIN gr b ON b.paper_id = dst), most AS (SELECT max(transfer) AS m FROM t),
x AS (SELECT src AS p, 0 AS i, 1 AS o, sim FROM t, most WHERE transfer > 0.5 * m UNION ALL SELECT dst, 1, 0, sim FROM t, most WHERE transfer > 0.5 * m)
SELECT p AS paper_id, sum(i)::BIGINT AS inbound, sum(o)::BIGINT AS outbound, count(*) AS total, round(avg(sim), 6) AS strength FROM x GROUP BY 1 HAVING count(*) >= 2""")
def transfer_wells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wells of edges whose information transfer is over 0.5; transfers are scaled by the largest, as those of the given texts are small."""
    e = edges(spark, sf_dir, g=sc.grounding(F.col("body"))).select("src", "dst", "sim", sc.transfer(F.col("src_g"), F.col("dst_g"), F.col("sim")).alias("transfer"))
    most = e.agg(F.max("transfer").alias("m"))
    scaled = e.crossJoin(F.broadcast(most))
    return g.gravity_wells(scaled, 2, F.col("transfer") > 0.5 * F.col("m")).withColumn("strength", F.round("strength", 6))


CAPITAL_SQL = r"regexp_matches(l, '^[^a-z0-9]*$') AND regexp_matches(l, '[A-Z]') AND regexp_matches(l, '[^\s]\s+[^\s]')"


@query(rf"""WITH {ALL_SQL}, li AS (SELECT doc_id, unnest(string_split(text, chr(10))[1:10]) AS l, generate_subscripts(string_split(text, chr(10))[1:10], 1) AS k FROM alltexts WHERE doc_id < 0),
c AS (SELECT doc_id, k, l FROM li WHERE length(l) <= 100 AND {CAPITAL_SQL})
SELECT doc_id, array_to_string(list_transform(string_split(lower(arg_min(l, k)), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS header FROM c GROUP BY doc_id""")
def capital_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers in capitals, in title case, of the texts above."""
    t = all_texts(spark, sf_dir).where("doc_id < 0")
    return t.select("doc_id", tx.section_header(F.col("text")).alias("header")).where("header IS NOT NULL")


@query(f"""WITH {SCORES}, x AS (SELECT toxic = 1 AS f, paper_id % 5 AS fold, unnest(['additive', 'multiplicative']) AS model, unnest([(w + h + c) / 3, w * h * c]) AS s FROM scores JOIN labels ON doc_id = paper_id),
p AS (SELECT a.model, a.fold, count(*) AS pairs, sum(CASE WHEN a.s > b.s THEN 1.0::DOUBLE WHEN a.s = b.s THEN 0.5::DOUBLE ELSE 0 END) AS win FROM x a JOIN x b ON a.model = b.model AND a.fold = b.fold AND a.f AND NOT b.f GROUP BY 1, 2),
m AS (SELECT model, fold, avg(s) FILTER (f) > avg(s) FILTER (NOT f) AS rises FROM (SELECT x.model, k AS fold, s, f FROM x, range(0, 5) r(k) WHERE x.fold <> k) GROUP BY 1, 2)
SELECT model, count(*) AS folds, round(avg(CASE WHEN rises THEN win / pairs ELSE 1 - win / pairs END), 6) AS auc FROM p JOIN m USING (model, fold) GROUP BY 1""")
def cross_validated_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean AUC over five folds of a logistic model of one score, fitted on the other four.

    Such a model is monotone in its score, so within a fold it ranks as the score does, or the other way round where its
    slope is negative; the slope has the sign of the difference of the labels' means.
    """
    s = tb.dimensional_scores(spark, sf_dir).withColumn("flag", F.col("t") == 0).withColumn("fold", F.col("paper_id") % 5)
    d = [F.col(x) for x in "whc"]
    out = []
    for name, score in (("additive", sc.additive(*d)), ("multiplicative", sc.information(*d))):
        x = s.select("fold", "flag", score.alias("s"))
        by = st.auc_by(x, "s", "flag", "fold").where("auc IS NOT NULL")
        sums = x.groupBy("fold", "flag").agg(F.sum("s").alias("t"), F.count(F.lit(1)).alias("n"))
        rest = sums.groupBy("flag").agg(F.sum("t").alias("all_t"), F.sum("n").alias("all_n"))
        means = sums.join(F.broadcast(rest), "flag").groupBy("fold").agg(*[F.max(F.when(F.col("flag") == v, F.try_divide(F.col("all_t") - F.col("t"), F.col("all_n") - F.col("n")))).alias(k) for k, v in (("up", True), ("down", False))])
        mean = by.join(means, "fold").agg(F.count(F.lit(1)).alias("folds"), F.round(F.avg(F.when(F.col("up") > F.col("down"), F.col("auc")).otherwise(1 - F.col("auc"))), 6).alias("auc"))
        out.append(mean.select(F.lit(name).alias("model"), "folds", "auc"))
    return out[0].unionByName(out[1])


@query("""WITH u AS (SELECT label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS v FROM embeddings),
s AS (SELECT label, i, sum(v[i]) AS s, count(*) AS n FROM u, range(1, 65) r(i) GROUP BY 1, 2)
SELECT label, any_value(n) AS n, round((sum(s * s) - any_value(n)) / (any_value(n) * (any_value(n) - 1)), 6) AS coherence FROM s GROUP BY 1 HAVING any_value(n) > 1""")
def label_coherence_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cosine of all pairs of a label's vectors, in one pass: (|sum of unit vectors|^2 - n) / (n (n - 1))."""
    return g.coherence(tb.table(spark, sf_dir, "embeddings").select("label", F.col("embedding").alias("v")), "label").withColumn("coherence", F.round("coherence", 6))


@query(f"WITH {EDGES} SELECT floor(sim * 10)::INTEGER AS bucket, printf('%.1f-%.1f', floor(sim * 10) / 10, floor(sim * 10) / 10 + 0.1) AS label, count(*) AS n FROM edges GROUP BY 1, 2")
def similarity_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenths of similarity with the range as a label."""
    by = edges(spark, sf_dir).groupBy(F.floor(F.col("sim") * 10).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return by.select("bucket", F.format_string("%.1f-%.1f", F.col("bucket") / 10, F.col("bucket") / 10 + 0.1).alias("label"), "n")


@query(r"""WITH h AS (SELECT page_id, regexp_extract_all(html, '(?s)<h[1-6][^>]*>(.*?)</h[1-6]>', 1) AS l FROM pages)
SELECT page_id, 'sec' || k AS section_id, x AS title FROM (SELECT page_id, unnest(l) AS x, generate_subscripts(l, 1) AS k FROM h)""")
def numbered_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of structured pages, numbered anew from 1."""
    heads = F.regexp_extract_all("html", F.lit(r"(?s)<h[1-6][^>]*>(.*?)</h[1-6]>"), F.lit(1))
    return tb.table(spark, sf_dir, "pages").select("page_id", F.inline(tx.numbered(heads, "sec"))).withColumnsRenamed({"id": "section_id", "text": "title"})


@query(r"""WITH c AS (SELECT page_id, regexp_extract_all(html, '(?s)<script>(.*?)</script>', 1) AS l FROM pages)
SELECT page_id, k::INTEGER AS block, 'unknown' AS language, length(x)::INTEGER AS n_chars FROM (SELECT page_id, unnest(l) AS x, generate_subscripts(l, 1) AS k FROM c)""")
def page_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts of pages, taken as fenced blocks of the marked-down text."""
    marked = F.regexp_replace("html", r"(?s)<script>(.*?)</script>", "```\n$1```")
    blocks = tb.table(spark, sf_dir, "pages").select("page_id", F.posexplode(tx.code_blocks(marked)).alias("k", "b"))
    return blocks.select("page_id", (F.col("k") + 1).alias("block"), "b.language", F.length("b.content").alias("n_chars"))


LINKS = r"<a href=\"([^\"()]+)\">([^<\]]*)</a>"


@query(f"""WITH c AS (SELECT page_id, regexp_extract_all(html, '{LINKS}', 2) AS t, regexp_extract_all(html, '{LINKS}', 1) AS p FROM pages)
SELECT page_id, 'fig' || k AS figure_id, CASE WHEN x = '' THEN 'Figure ' || k ELSE x END AS caption, y AS path FROM (SELECT page_id, unnest(t) AS x, unnest(p) AS y, generate_subscripts(t, 1) AS k FROM c)""")
def page_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered figures with captions and paths; the given pages have no images, so their links stand for them."""
    marked = F.regexp_replace(F.regexp_replace("html", r"!\[", "! ["), LINKS, r"![$2]($1)")
    return tb.table(spark, sf_dir, "pages").select("page_id", F.inline(tx.figures(marked)))


@query(f"""WITH c AS (SELECT page_id, regexp_extract_all(html, '{LINKS}', 1) AS r, regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1) AS l FROM pages),
u AS (SELECT page_id, unnest(r) AS text, 'ref' || generate_subscripts(r, 1) AS id FROM c UNION ALL SELECT page_id, unnest(l), 'item' || generate_subscripts(l, 1) FROM c) SELECT page_id, id, text FROM u""")
def numbered_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References and list entries of pages, each kind numbered anew from 1."""
    kinds = {"ref": (LINKS, 1), "item": ("(?s)<li>(.*?)</li>", 1)}
    lists = [tx.numbered(F.regexp_extract_all("html", F.lit(p), F.lit(g)), name) for name, (p, g) in kinds.items()]
    return tb.table(spark, sf_dir, "pages").select("page_id", F.inline(F.concat(*lists)))


@query(f"""WITH {EDGES} SELECT src, dst, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN i <= 8 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END * pow(a.v[i] - b.v[i], 2)))), 6) AS distance FROM edges JOIN papers a ON a.paper_id = src JOIN papers b ON b.paper_id = dst""")
def weighted_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of similar papers in which the first dimensions weigh more."""
    weights = np.where(np.arange(64) < 8, 2.0, 0.5)
    e = edges(spark, sf_dir, measure=lambda x, y: np.sqrt(((x - y) ** 2) @ weights[: x.shape[1]]))
    return e.select("src", "dst", r6("measure", "distance"))


@query(f"WITH {EDGES} SELECT src, dst, round(sim, 6) AS sim, round(pow(sim, 1.5), 6) AS context FROM edges WHERE sim > 0.35")
def insert_select_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges are stored, a selection of them is inserted into a second table with a computed column, and that is read back."""
    store = VersionedStore(spark, shared_folder(spark, "store"))
    store.commit({"edges": edges(spark, sf_dir)})
    store.commit({"amplified": store.read("edges").where("sim > 0.35").select("src", "dst", "sim", sc.amplify(F.col("sim")).alias("context"))})
    return store.read("amplified").select("src", "dst", r6("sim"), r6("context"))
