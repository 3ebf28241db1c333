"""Queries over the similarity graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions import scores as sc
from lattica.functions import text as tx
from lattica.functions.vector import cosine, dot, norm, unit
from lattica.operators import graph as g
from lattica.operators import ordered, walks
from lattica.operators import pairs as pr
from lattica.plans.registry import BOTH, EDGE_THRESHOLD, EDGES, PAPERS, query
from lattica.sources import tables as tb
from lattica.sources.scratch import settle

CHUNK_PAIRS = """cv AS (SELECT vec_id AS id, vec_id // 5 AS paper, (vec_id % 5)::INTEGER AS chunk_index, embedding::DOUBLE[] AS v FROM embeddings),
cp AS (SELECT a.id AS src, b.id AS dst, list_cosine_similarity(a.v, b.v) AS sim, a.paper AS from_paper, b.paper AS to_paper FROM cv a JOIN cv b ON a.id < b.id WHERE a.paper <> b.paper AND list_cosine_similarity(a.v, b.v) >= 0.2),
ds AS (SELECT from_paper, to_paper, count(*) AS n, max(sim) AS mx, avg(sim) AS mn, list_avg(list_sort(list(sim), 'DESC')[1:5]) AS tk FROM cp GROUP BY 1, 2)"""


def edges(spark: SparkSession, sf_dir: str, threshold: float = EDGE_THRESHOLD, measure: Callable | None = None, **carry: str | Column) -> DataFrame:
    """src < dst, sim of all papers; ``carry`` names columns of papers that come with both ends, as src_ and dst_ of the name, ``measure`` a function of both ends' embeddings."""
    own = [(F.col(c) if isinstance(c, str) else c).alias(k) for k, c in carry.items()]
    return pr.similar_pairs(tb.papers(spark, sf_dir).select(F.col("paper_id").alias("id"), F.col("embedding").alias("v"), *own), threshold, carry=list(carry), measure=measure)


def r6(c: str | F.Column, name: str | None = None):  # noqa: ANN201
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6).alias(name or c)


@query(f"""WITH {EDGES} SELECT src, dst, round(sim, 6) AS sim, abs(a.year - b.year) AS year_gap, a.primary_category = b.primary_category AS category_match
FROM edges JOIN papers a ON a.paper_id = src JOIN papers b ON b.paper_id = dst""")
def pair_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir, year="year", primary_category="primary_category")
    return e.select("src", "dst", r6("sim"), F.abs(F.col("src_year") - F.col("dst_year")).alias("year_gap"), (F.col("src_primary_category") == F.col("dst_primary_category")).alias("category_match"))


@query(f"""WITH {EDGES} SELECT src, dst, round(sim, 6) AS context_original, round(pow(sim, 1.5), 6) AS context_amplified, 1.5::DOUBLE AS alpha_used, round(pow(sim, 1.5) / sim - 1, 6) AS change FROM edges""")
def amplified_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.amplification_change(edges(spark, sf_dir)).select("src", "dst", r6("context_original"), r6("context_amplified"), "alpha_used", r6("change"))


@query(f"""WITH {EDGES} SELECT src, dst, round(sim, 6) AS sim, round(pow(sim, 1.5), 6) AS amplified, a.title AS src_title, b.title AS dst_title
FROM edges JOIN papers a ON a.paper_id = src JOIN papers b ON b.paper_id = dst ORDER BY edges.sim DESC, src, dst LIMIT 10""")
def top_similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top edges are cut before titles are looked up, so only ten rows are joined."""
    top = edges(spark, sf_dir).orderBy(F.desc("sim"), "src", "dst").limit(10)
    return g.enrich(top, tb.papers(spark, sf_dir), ["title"]).select("src", "dst", r6("sim"), r6(sc.amplify(F.col("sim")), "amplified"), "src_title", "dst_title")


@query(f"WITH {EDGES} SELECT floor(sim * 10) / 10 AS bucket, count(*) AS n FROM edges GROUP BY 1")
def similarity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).groupBy((F.floor(F.col("sim") * 10).cast("double") / 10).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EDGES} SELECT floor(sim * 20) / 20 AS bucket, count(*) AS n, round(avg(sim), 6) AS mean, round(min(sim), 6) AS least, round(max(sim), 6) AS most FROM edges GROUP BY 1""")
def similarity_histogram_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir).groupBy((F.floor(F.col("sim") * 20).cast("double") / 20).alias("bucket"))
    return e.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("sim"), 6).alias("mean"), F.round(F.min("sim"), 6).alias("least"), F.round(F.max("sim"), 6).alias("most"))


@query(f"WITH {EDGES}, t AS (SELECT unnest([0.3, 0.35, 0.4, 0.45, 0.5])::DOUBLE AS threshold) SELECT threshold, count(sim) AS n FROM t LEFT JOIN edges ON sim > threshold GROUP BY 1")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass counts all thresholds."""
    at = [0.3, 0.35, 0.4, 0.45, 0.5]
    one = edges(spark, sf_dir).agg(*[F.count_if(F.col("sim") > t).alias(f"n{i}") for i, t in enumerate(at)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"n{i}").alias("n")) for i, t in enumerate(at)])))


@query(f"""WITH {BOTH.replace("> 0.3)", ">= 0.3)")}, r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rank FROM both_ways)
SELECT src, dst, round(sim, 6) AS sim, rank::INTEGER AS rank FROM r WHERE rank <= 49""")
def knn_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty nearest, of which a paper itself is one."""
    v = tb.papers(spark, sf_dir).select(F.col("paper_id").alias("id"), F.col("embedding").alias("v"))
    return pr.nearest(v, 49, 0.3).select("src", "dst", r6("sim"), "rank")


@query(f"""WITH {EDGES} SELECT count(*) AS n, round(avg(sim), 6) AS mean_before, round(stddev_pop(sim), 6) AS sd_before, round(avg(pow(sim, 1.5)), 6) AS mean_after, round(stddev_pop(pow(sim, 1.5)), 6) AS sd_after,
round(min(pow(sim, 1.5)), 6) AS min_after, round(max(pow(sim, 1.5)), 6) AS max_after FROM edges""")
def amplification_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = g.amplified(edges(spark, sf_dir))
    a = "context_amplified"
    return e.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("sim"), 6).alias("mean_before"), F.round(F.stddev_pop("sim"), 6).alias("sd_before"), F.round(F.avg(a), 6).alias("mean_after"), F.round(F.stddev_pop(a), 6).alias("sd_after"), F.round(F.min(a), 6).alias("min_after"), F.round(F.max(a), 6).alias("max_after"))


@query(f"""WITH {EDGES}, x AS (SELECT src AS p, 0 AS i, 1 AS o, sim FROM edges UNION ALL SELECT dst, 1, 0, sim FROM edges)
SELECT p AS paper_id, sum(i)::BIGINT AS inbound, sum(o)::BIGINT AS outbound, count(*) AS total, round(avg(sim), 6) AS strength FROM x GROUP BY 1 HAVING count(*) >= 10""")
def gravity_wells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.gravity_wells(edges(spark, sf_dir), 10).withColumn("strength", F.round("strength", 6))


@query(f"""WITH {EDGES}, gr AS (SELECT paper_id, {" + ".join(f"CASE WHEN {' OR '.join(f'contains(lower(body), {s!r})' for s in sc.GROUNDING_SIGNS[n])} THEN {p}.0::DOUBLE ELSE 0 END" for n, p in sc.GROUNDING.items())} AS pts FROM papers),
x AS (SELECT (a.pts / 200 + b.pts / 200) / 2 * pow(sim, 1.5) AS it FROM edges JOIN gr a ON a.paper_id = src JOIN gr b ON b.paper_id = dst)
SELECT (SELECT count(*) FROM papers) AS papers, count(*) AS edges, round(avg(it), 6) AS mean_transfer, round(min(it), 6) AS min_transfer, round(max(it), 6) AS max_transfer FROM x""")
def network_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tb.papers(spark, sf_dir)
    e = edges(spark, sf_dir, g=sc.grounding(F.col("body")))
    it = sc.transfer(F.col("src_g"), F.col("dst_g"), F.col("sim"))
    stats = e.select(it.alias("it")).agg(F.count(F.lit(1)).alias("edges"), F.round(F.avg("it"), 6).alias("mean_transfer"), F.round(F.min("it"), 6).alias("min_transfer"), F.round(F.max("it"), 6).alias("max_transfer"))
    return p.agg(F.count(F.lit(1)).alias("papers")).crossJoin(stats)


CONCEPTS = ["threa", "chlich", "reau"]


@query(f"""WITH {BOTH}, s AS (SELECT k AS concept, paper_id FROM papers, (SELECT unnest({CONCEPTS}) AS k) WHERE contains(lower(title), k) OR contains(lower(abstract), k)),
o AS (SELECT concept, paper_id, dst AS other, sim, least(src, dst) AS x, greatest(src, dst) AS y, 1 AS hops FROM s JOIN both_ways ON src = paper_id),
t AS (SELECT concept, paper_id, b.dst AS other, b.sim, 2 AS hops FROM o JOIN both_ways b ON b.src = o.other AND NOT (least(b.src, b.dst) = x AND greatest(b.src, b.dst) = y)),
a AS (SELECT concept, paper_id, other, sim, hops FROM o UNION ALL SELECT concept, paper_id, other, sim, hops FROM t)
SELECT concept, paper_id, count(*) AS paths, count(DISTINCT other) AS reached, round(avg(sim), 6) AS strength, count(*) FILTER (hops = 2) AS second_hop FROM a WHERE sim > 0.32 GROUP BY 1, 2""")
def concept_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tb.papers(spark, sf_dir)
    at = F.explode(F.array(*map(F.lit, CONCEPTS)))
    seeds = p.select("paper_id", "title", "abstract", at.alias("concept")).where(F.contains(F.lower("title"), F.col("concept")) | F.contains(F.lower("abstract"), F.col("concept"))).select("concept", "paper_id")
    near = g.neighbours(edges(spark, sf_dir), seeds.select("paper_id").distinct(), F.col("sim") > 0.32)
    stats = near.groupBy("paper_id").agg(F.count(F.lit(1)).alias("paths"), F.count_distinct("other").alias("reached"), F.round(F.avg("sim"), 6).alias("strength"), F.count_if(F.col("hops") == 2).alias("second_hop"))
    return seeds.join(stats, "paper_id")


@query(f"""WITH {EDGES}, f AS (SELECT paper_id, contains(lower(title), 'the') OR contains(lower(title), 'con') AS th, contains(lower(title), 'ein') OR contains(lower(title), 'que') AS pr FROM papers)
SELECT src, dst, round(sim, 6) AS sim FROM edges JOIN f a ON a.paper_id = src JOIN f b ON b.paper_id = dst WHERE (a.th AND b.pr) OR (b.th AND a.pr)""")
def theory_practice_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of theory and practice are those that invented titles have."""
    t = F.col("title")
    return g.bridges(edges(spark, sf_dir), tx.mentions(t, ["the", "con"]), tx.mentions(t, ["ein", "que"]), tb.papers(spark, sf_dir)).select("src", "dst", r6("sim"))


@query(f"""WITH {PAPERS} SELECT paper_id, ((list_sum(list_transform(v, lambda x: abs(x))) > 5)::INTEGER + (length(body) > 1000)::INTEGER + (len(categories) > 2)::INTEGER) AS score FROM papers ORDER BY score DESC, paper_id LIMIT 3""")
def bridge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tb.papers(spark, sf_dir)
    size = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.abs(x))
    return p.select("paper_id", sc.bridge_score(size, F.length("body"), F.size("categories")).alias("score")).orderBy(F.desc("score"), "paper_id").limit(3)


@query(f"""WITH {EDGES}, e AS (SELECT a.label AS ca, b.label AS cb FROM edges JOIN papers a ON a.paper_id = src JOIN papers b ON b.paper_id = dst), m AS (SELECT count(*) AS m FROM e),
x AS (SELECT ca AS c, ca = cb AS same FROM e UNION ALL SELECT cb, ca = cb FROM e)
SELECT c AS cluster, round(count(*) FILTER (same) / 2.0::DOUBLE, 6) AS inside, count(*) AS degree, round(count(*) FILTER (same) / 2.0::DOUBLE / any_value(m) - pow(count(*) / (2.0::DOUBLE * any_value(m)), 2), 6) AS part FROM x, m GROUP BY 1""")
def modularity_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = g.modularity(edges(spark, sf_dir), tb.papers(spark, sf_dir).select("paper_id", F.col("label").alias("cluster")))
    return m.select("cluster", r6("inside"), "degree", r6("part"))


@query(f"""WITH {BOTH.replace("> 0.3)", "> 0.2)")}, l AS (SELECT unnest([0, 1, 2, 3]) AS level), gr AS (SELECT paper_id, level FROM papers, l),
d AS (SELECT gr.paper_id, gr.level, count(b.src) + 1 AS degree FROM gr LEFT JOIN both_ways b ON b.src = gr.paper_id AND b.sim > 0.35 - 0.05 * gr.level GROUP BY 1, 2)
SELECT level, count(*) AS papers, round(avg(degree), 6) AS mean_degree, max(degree) AS max_degree FROM d GROUP BY 1""")
def scale_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = g.degrees(edges(spark, sf_dir, 0.2), tb.papers(spark, sf_dir), [0.35, 0.35 - 0.05, 0.35 - 0.05 * 2, 0.35 - 0.05 * 3])
    return d.groupBy("level").agg(F.count(F.lit(1)).alias("papers"), F.round(F.avg("degree"), 6).alias("mean_degree"), F.max("degree").alias("max_degree"))


MEANS = "m AS (SELECT label, d, avg(x) AS x FROM (SELECT label, unnest(range(1, 65)) AS d, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY 1, 2)"


@query(f"""WITH {MEANS} SELECT a.label AS label_a, b.label AS label_b, round(sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))), 6) AS sim FROM m a JOIN m b ON a.d = b.d AND a.label < b.label GROUP BY 1, 2""")
def label_heatmap_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = g.group_means(tb.table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v")), "label")
    v = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda s: s["value"]).alias("v"))
    a, b = v.alias("a"), v.alias("b")
    return a.join(b, F.col("a.label") < F.col("b.label")).select(F.col("a.label").alias("label_a"), F.col("b.label").alias("label_b"), F.round(cosine(F.col("a.v"), F.col("b.v")), 6).alias("sim"))


@query("""WITH f AS (SELECT label, vec_id, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings)
SELECT a.label, count(*) AS pairs, round(avg(list_cosine_similarity(a.v, b.v)), 6) AS coherence FROM f a JOIN f b ON a.label = b.label AND a.vec_id < b.vec_id WHERE a.k <= 50 AND b.k <= 50 GROUP BY 1""")
def label_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cosine among the first fifty of each label, as the measure is defined."""
    e = tb.table(spark, sf_dir, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    first = e.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).where("k <= 50").where(norm(F.col("v")) > 0)
    a, b = first.alias("a"), first.alias("b")
    pairs = a.join(b, (F.col("a.label") == F.col("b.label")) & (F.col("a.vec_id") < F.col("b.vec_id")))
    return pairs.groupBy(F.col("a.label").alias("label")).agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(cosine(F.col("a.v"), F.col("b.v"))), 6).alias("coherence"))


@query(f"""WITH {PAPERS} SELECT year, (d - 1)::INTEGER AS dim, round(avg(x), 6) AS value FROM (SELECT year, unnest(range(1, 65)) AS d, unnest(v) AS x FROM papers) GROUP BY 1, 2""")
def year_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = g.group_means(tb.papers(spark, sf_dir).select("year", F.col("embedding").alias("v")), "year")
    return m.select("year", "dim", r6("value"))


@query(f"""WITH {CHUNK_PAIRS} SELECT from_paper, to_paper, n AS num_chunk_pairs, round(mx, 6) AS max, round(mn, 6) AS mean, round(mn, 6) AS weighted_mean, round(tk, 6) AS top_k_mean FROM ds""")
def doc_similarity_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Chunk pairs weigh the same, so that their weighted mean is their mean.
    d = pr.document_pairs(tb.chunk_vectors(spark, sf_dir), 0.2).withColumn("weighted_mean", F.col("mean"))
    return d.select("from_paper", "to_paper", "num_chunk_pairs", *[r6(m) for m in g.METHODS])


@query("""WITH cv AS (SELECT vec_id // 5 AS paper, exp(-0.1 * (vec_id % 5)) AS w, embedding::DOUBLE[] AS v FROM embeddings),
x AS (SELECT paper, d, sum(w * x) / sum(w) AS x FROM (SELECT paper, w, unnest(range(0, 64)) AS d, unnest(v) AS x FROM cv) GROUP BY 1, 2), n AS (SELECT paper, sqrt(sum(x * x)) AS n FROM x GROUP BY 1)
SELECT paper, d::INTEGER AS dim, round(x / n, 6) AS value FROM x JOIN n USING (paper)""")
def doc_embedding_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.document_vectors(tb.chunk_vectors(spark, sf_dir)).select("paper", "dim", r6("value"))


@query(f"""WITH {CHUNK_PAIRS}, u AS (SELECT 'max' AS method, mx AS s FROM ds WHERE mx >= 0.25 UNION ALL SELECT 'top_k_mean', tk FROM ds WHERE tk >= 0.25 UNION ALL SELECT 'document', sim FROM cp WHERE sim > 0.4)
SELECT method, count(*) AS n, round(avg(s), 6) AS mean FROM u GROUP BY 1""")
def edge_union_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents by two methods, made in one pass, and pairs of chunks."""
    chunks = tb.chunk_vectors(spark, sf_dir)
    methods = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("similarity")) for m in ("max", "top_k_mean")]))
    some = pr.document_pairs(chunks, 0.2).select(methods.alias("m")).select("m.*").where("similarity >= 0.25")
    plain = pr.cross_paper_pairs(chunks, 0.4, inclusive=False).select(F.lit("document").alias("method"), F.col("sim").alias("similarity"))
    union = some.unionByName(plain)
    return union.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("similarity"), 6).alias("mean"))


@query("""WITH cv AS (SELECT vec_id AS id, vec_id // 5 AS paper, embedding::DOUBLE[] AS v FROM embeddings)
SELECT a.id AS src, b.id AS dst, round(list_cosine_similarity(a.v, b.v), 6) AS sim, a.paper AS from_paper, b.paper AS to_paper FROM cv a JOIN cv b ON a.id < b.id AND a.paper = b.paper WHERE list_cosine_similarity(a.v, b.v) >= 0.1""")
def same_paper_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.cross_paper_pairs(tb.chunk_vectors(spark, sf_dir), 0.1, same_paper=True).withColumn("sim", F.round("sim", 6))


@query(f"""WITH {EDGES}, c AS (SELECT CASE WHEN a.year > b.year THEN src ELSE dst END AS citing, CASE WHEN a.year > b.year THEN dst ELSE src END AS cited FROM edges JOIN papers a ON a.paper_id = src JOIN papers b ON b.paper_id = dst WHERE a.year <> b.year)
SELECT x.cited AS a, y.cited AS b, count(*) AS together FROM c x JOIN c y ON x.citing = y.citing AND x.cited < y.cited GROUP BY 1, 2""")
def co_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.co_citations(citations(spark, sf_dir))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src cites dst: similar papers, the later cites the earlier."""
    return _cited(edges(spark, sf_dir, year="year"))


def _cited(dated: DataFrame) -> DataFrame:
    e = dated.where("src_year <> dst_year")
    later = F.col("src_year") > F.col("dst_year")
    return e.select(F.when(later, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(later, F.col("dst")).otherwise(F.col("src")).alias("dst"))


@query(f"""WITH {BOTH} SELECT a.year, count(*) AS links, round(avg(sim), 6) AS context FROM both_ways JOIN papers a ON a.paper_id = src JOIN papers b ON b.paper_id = dst WHERE b.year < a.year GROUP BY 1""")
def context_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean similarity of papers to earlier ones, by year."""
    e = edges(spark, sf_dir, year="year").where("src_year <> dst_year")
    return e.groupBy(F.greatest("src_year", "dst_year").alias("year")).agg(F.count(F.lit(1)).alias("links"), F.round(F.avg("sim"), 6).alias("context"))


@query(f"""WITH {PAPERS} SELECT a.paper_id, a.year, count(b.paper_id) AS earlier, round(avg(list_cosine_similarity(a.v, b.v)), 6) AS context FROM papers a LEFT JOIN papers b ON b.year < a.year GROUP BY 1, 2""")
def context_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean similarity of each paper to all earlier ones, without a threshold and without their pairs."""
    c = ordered.context_before(tb.papers(spark, sf_dir), "paper_id", "year", "embedding")
    return c.select("paper_id", "year", "earlier", r6("context"))


@query(f"""WITH RECURSIVE {BOTH}, n AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS pos, count(*) OVER (PARTITION BY src) AS size FROM (SELECT DISTINCT src, dst FROM both_ways)),
w AS (SELECT DISTINCT src AS start, walk, 0 AS step, src AS node FROM n, (SELECT unnest([0, 1, 2]) AS walk)
  UNION ALL SELECT start, walk, step + 1, dst FROM w JOIN n ON src = node AND pos = ('0x' || md5('42:' || start || ':' || walk || ':' || (step + 1))[1:8])::BIGINT % size WHERE step < 6)
SELECT start, walk::INTEGER AS walk, step::INTEGER AS step, node FROM w""")
def random_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three walks of six steps from each paper that has an edge."""
    return walks.random_walks(edges(spark, sf_dir), 3, 6)


@query()
def node_vector_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well vectors of nodes tell edges from pairs without one: mean cosine of both, for all papers with an edge."""
    e = settle(edges(spark, sf_dir), "edges")
    v = settle(walks.node_vectors(e).withColumn("u", unit(F.col("v"))), "node-vectors")
    x, y = v.select(F.col("id").alias("src"), F.col("u").alias("a")), v.select(F.col("id").alias("dst"), F.col("u").alias("b"))
    linked = e.join(x, "src").join(y, "dst").agg(F.round(F.avg(dot(F.col("a"), F.col("b"))), 3).alias("linked"), F.count(F.lit(1)).alias("edges"))
    # The mean over all pairs is the squared length of the mean vector.
    mean = v.select(F.posexplode("u").alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("x")).agg(F.round(F.sum(F.col("x") * F.col("x")), 3).alias("any"))
    return linked.crossJoin(mean)


@query(f"""WITH RECURSIVE {BOTH}, f AS (SELECT 0::BIGINT AS paper_id, 0 AS distance UNION SELECT dst, distance + 1 FROM f JOIN both_ways ON src = paper_id WHERE distance < 4)
SELECT paper_id, min(distance)::INTEGER AS distance, round(1 / (1 + min(distance)::DOUBLE), 6) AS where_score FROM f GROUP BY 1""")
def hop_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = g.distances(edges(spark, sf_dir), spark.range(1).withColumnRenamed("id", "paper_id"), 4)
    return d.select("paper_id", "distance", r6(sc.where_score(F.col("distance")), "where_score"))


@query(f"""WITH {EDGES}, cv AS (SELECT vec_id AS id, vec_id // 5 AS paper, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT paper, count(*) AS n FROM cv GROUP BY 1),
m AS (SELECT DISTINCT a.id AS chunk, a.paper AS src, b.paper AS dst FROM cv a JOIN cv b ON a.paper <> b.paper AND list_cosine_similarity(a.v, b.v) >= 0.2), sh AS (SELECT src, dst, count(*) AS k FROM m GROUP BY 1, 2),
ci AS (SELECT CASE WHEN a.year > b.year THEN src ELSE dst END AS citing, CASE WHEN a.year > b.year THEN dst ELSE src END AS cited FROM edges JOIN papers a ON a.paper_id = src JOIN papers b ON b.paper_id = dst WHERE a.year <> b.year),
co AS (SELECT x.cited AS a, y.cited AS b, count(*) AS together FROM ci x JOIN ci y ON x.citing = y.citing AND x.cited < y.cited GROUP BY 1, 2),
t AS (SELECT e.src, e.dst, e.sim, a.year AS ya, b.year AS yb, coalesce(sh.k / n.n::DOUBLE, 0) AS propagation, CASE WHEN ci.citing IS NOT NULL THEN 1.0::DOUBLE ELSE coalesce(together / (together + 1.0::DOUBLE), 0) END AS citation
  FROM edges e JOIN papers a ON a.paper_id = e.src JOIN papers b ON b.paper_id = e.dst LEFT JOIN n ON n.paper = e.src LEFT JOIN sh ON sh.src = e.src AND sh.dst = e.dst
  LEFT JOIN ci ON least(ci.citing, ci.cited) = e.src AND greatest(ci.citing, ci.cited) = e.dst LEFT JOIN co ON co.a = e.src AND co.b = e.dst)
SELECT src, dst, round(propagation, 6) AS propagation, round(citation, 6) AS citation, round(CASE WHEN ya > yb THEN 0.0::DOUBLE ELSE 0.4 * sim + 0.2 * (1 - abs(yb - ya) / 9.0::DOUBLE) + 0.2 * propagation + 0.2 * citation END, 6) AS frame,
CASE WHEN ya > yb THEN 0.0::DOUBLE ELSE round(0.8 * pow(sim, 1.5), 6) END AS gated FROM t""")
def frame_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How strongly the later paper of an edge continues the earlier: similarity, time, the share of chunks that reach it, and citations."""
    e = settle(edges(spark, sf_dir), "edges")
    papers = tb.papers(spark, sf_dir).select("paper_id", "year")
    dated = settle(g.enrich(e, papers, ["year"]), "dated")
    cited = settle(_cited(dated), "citations")
    chunks = tb.chunk_vectors(spark, sf_dir)
    reach = g.propagation(pr.cross_paper_pairs(chunks, 0.2), chunks)
    full = dated.join(reach, ["src", "dst"], "left").join(g.citation_strength(cited), ["src", "dst"], "left").na.fill(0.0, ["propagation", "citation"])
    a, b = F.col("src_year"), F.col("dst_year")
    frame = sc.frame(a, b, {"semantic": (0.4, F.col("sim")), "temporal": (0.2, sc.when_score(b - a, F.lit(9.0))), "propagation": (0.2, F.col("propagation")), "citation": (0.2, F.col("citation"))})
    return full.select("src", "dst", r6("propagation"), r6("citation"), r6(frame, "frame"), r6(sc.observed((a <= b).cast("int"), F.lit(0.8), sc.amplify(F.col("sim"))), "gated"))
