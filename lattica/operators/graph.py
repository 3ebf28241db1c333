"""Operators over edge tables (src, dst, sim): degrees, hops, communities, bridges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.scores import ALPHA, amplify, change
from lattica.functions.vector import as_double, norm, unit


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "sim").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "sim"))


def enrich(edges: DataFrame, papers: DataFrame, columns: list[str]) -> DataFrame:
    """Edges with the named columns of both ends (src_*, dst_*); null where an end is missing."""
    own = papers.select("paper_id", *columns)
    a = own.select(F.col("paper_id").alias("src"), *[F.col(c).alias(f"src_{c}") for c in columns])
    b = own.select(F.col("paper_id").alias("dst"), *[F.col(c).alias(f"dst_{c}") for c in columns])
    return edges.join(a, "src", "left").join(b, "dst", "left")


def amplified(edges: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Adds context_original, context_amplified, alpha_used; edges that have an original context stay as they are."""
    if "context_original" not in edges.columns:
        edges = edges.withColumns({"context_original": F.lit(None).cast("double"), "context_amplified": F.lit(None).cast("double"), "alpha_used": F.lit(None).cast("double")})
    fresh = F.col("context_original").isNull()
    return edges.withColumns({
        "context_amplified": F.when(fresh, amplify(F.col("sim"), alpha)).otherwise(F.col("context_amplified")),
        "alpha_used": F.when(fresh, F.lit(alpha)).otherwise(F.col("alpha_used")),
        "context_original": F.coalesce("context_original", "sim"),
    })


def amplification_change(edges: DataFrame, alpha: float = ALPHA) -> DataFrame:
    return amplified(edges, alpha).withColumn("change", change(F.col("context_original"), alpha))


def gravity_wells(edges: DataFrame, min_connections: int, condition: Column | None = None) -> DataFrame:
    """paper_id, inbound, outbound, total, strength of papers with enough connections; ``condition`` says which edges count, such as ``transfer > 0.5``."""
    ends = (edges if condition is None else edges.where(condition)).select(F.explode(F.array(F.struct(F.col("src").alias("paper_id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("paper_id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"), "sim")
    out = ends.groupBy("e.paper_id").agg(F.sum("e.i").alias("inbound"), F.sum("e.o").alias("outbound"), F.count(F.lit(1)).alias("total"), F.avg("sim").alias("strength"))
    return out.where(F.col("total") >= min_connections)


def neighbours(edges: DataFrame, seeds: DataFrame, last: Column | None = None) -> DataFrame:
    """paper_id, other, hops, sim: ends of all paths of one or two different edges from the seeds (paper_id).

    An end counts once for each path; ``last`` is a condition on the last edge (sim).
    """
    e = both_ways(edges).withColumn("edge", F.struct(F.least("src", "dst"), F.greatest("src", "dst")))
    one = seeds.select("paper_id").join(e, F.col("paper_id") == F.col("src")).select("paper_id", F.col("dst").alias("other"), "sim", "edge", F.lit(1).alias("hops"))
    step = e.select(F.col("src").alias("at"), "dst", F.col("sim").alias("sim2"), F.col("edge").alias("edge2"))
    two = one.join(step, (F.col("other") == F.col("at")) & (F.col("edge") != F.col("edge2"))).select("paper_id", F.col("dst").alias("other"), F.col("sim2").alias("sim"), F.col("edge2").alias("edge"), F.lit(2).alias("hops"))
    paths = one.unionByName(two)
    return (paths if last is None else paths.where(last)).select("paper_id", "other", "hops", "sim")


def distances(edges: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """paper_id, distance: hops from the nearest seed, up to ``most``; by frontier joins."""
    e = both_ways(edges).select("src", "dst")
    seen = seeds.select("paper_id", F.lit(0).alias("distance"))
    for hop in range(1, most + 1):
        front = seen.where(F.col("distance") == hop - 1).join(e, F.col("paper_id") == F.col("src")).select(F.col("dst").alias("paper_id")).distinct()
        seen = seen.unionByName(front.join(seen.select("paper_id"), "paper_id", "left_anti").select("paper_id", F.lit(hop).alias("distance")))
    return seen


def degrees(edges: DataFrame, nodes: DataFrame, thresholds: list[float]) -> DataFrame:
    """paper_id, level, degree (itself counted) at each threshold; level 0 is the first."""
    at = F.posexplode(F.array(*map(F.lit, thresholds)))
    links = both_ways(edges).select("src", "sim", at.alias("level", "least")).where(F.col("sim") > F.col("least")).groupBy("src", "level").agg(F.count(F.lit(1)).alias("d"))
    grid = nodes.select("paper_id", at.alias("level", "least")).select("paper_id", "level")
    return grid.join(links.withColumnRenamed("src", "paper_id"), ["paper_id", "level"], "left").select("paper_id", "level", (F.coalesce("d", F.lit(0)) + 1).alias("degree"))


def modularity(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """cluster, inside, degree, part: each cluster's part of the modularity of an unweighted graph; assignment is (paper_id, cluster)."""
    a, b = assignment.select(F.col("paper_id").alias("src"), F.col("cluster").alias("ca")), assignment.select(F.col("paper_id").alias("dst"), F.col("cluster").alias("cb"))
    e = edges.join(a, "src").join(b, "dst").select("ca", "cb")
    ends = e.select(F.explode(F.array("ca", "cb")).alias("cluster"), (F.col("ca") == F.col("cb")).alias("same"))
    by = ends.groupBy("cluster").agg((F.count_if("same") / 2).alias("inside"), F.count(F.lit(1)).alias("degree"))
    m = e.agg(F.count(F.lit(1)).alias("m"))
    return by.crossJoin(F.broadcast(m)).select("cluster", "inside", "degree", (F.col("inside") / F.col("m") - F.pow(F.col("degree") / (2 * F.col("m")), F.lit(2.0))).alias("part"))


def co_citations(citations: DataFrame, block: int = 1024) -> DataFrame:
    """a < b, together: how many papers cite both; citations are (src, dst), repeated ones count once.

    References of a citing paper are dealt by hash into blocks of about ``block``, and each cell of two blocks is a key
    of the join, so that a paper with very many references is the work of many tasks and no list is ever built.
    """
    refs = citations.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    size = refs.groupBy("src").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n"))
    dealt = refs.join(size, "src").withColumns({"own": F.pmod(F.xxhash64("dst"), F.col("n")).cast("int"), "other": F.explode(F.sequence(F.lit(0), F.col("n") - 1))})
    left = dealt.select("src", F.col("dst").alias("a"), F.col("own").alias("i"), F.col("other").alias("j"))
    right = dealt.select("src", F.col("dst").alias("b"), F.col("other").alias("i"), F.col("own").alias("j"))
    return left.join(right, ["src", "i", "j"]).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("together"))


def propagation(chunk_pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    """src, dst, propagation: the share of a paper's chunks that are like a chunk of the other, in both directions.

    Chunk pairs are (src, dst, from_paper, to_paper), chunks (id, paper). A chunk counts once, however many it is like.
    """
    one = chunk_pairs.select(F.col("src").alias("chunk"), F.col("from_paper").alias("src"), F.col("to_paper").alias("dst"))
    other = chunk_pairs.select(F.col("dst").alias("chunk"), F.col("to_paper").alias("src"), F.col("from_paper").alias("dst"))
    matched = one.unionByName(other).distinct().groupBy("src", "dst").agg(F.count(F.lit(1)).alias("k"))
    sizes = chunks.groupBy(F.col("paper").alias("src")).agg(F.count(F.lit(1)).alias("n"))
    return matched.join(sizes, "src").select("src", "dst", (F.col("k") / F.col("n")).alias("propagation"))


def citation_strength(citations: DataFrame) -> DataFrame:
    """src < dst, citation: 1 where one of two papers cites the other, else n / (n + 1) where n papers cite both."""
    direct = citations.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct().withColumn("citation", F.lit(1.0))
    both = co_citations(citations).select(F.col("a").alias("src"), F.col("b").alias("dst"), (F.col("together") / (F.col("together") + 1.0)).alias("citation"))
    return direct.unionByName(both).groupBy("src", "dst").agg(F.max("citation").alias("citation"))


def bridges(edges: DataFrame, theory: Column, practice: Column, papers: DataFrame) -> DataFrame:
    """Edges with theory at one end and practice at the other; the conditions are on columns of ``papers``."""
    flags = papers.select("paper_id", theory.alias("theory"), practice.alias("practice"))
    e = enrich(edges, flags, ["theory", "practice"])
    return e.where((F.col("src_theory") & F.col("dst_practice")) | (F.col("dst_theory") & F.col("src_practice"))).select("src", "dst", "sim")


def document_similarity(chunk_pairs: DataFrame, k: int = 5, weight: str | None = None) -> DataFrame:
    """from_paper < to_paper, num_chunk_pairs and similarity by maximum, mean, weighted mean and mean of the k highest.

    The list behind the k highest is one of a single pair of documents, at most the product of their numbers of chunks.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    p = chunk_pairs.select(F.least("from_paper", "to_paper").alias("from_paper"), F.greatest("from_paper", "to_paper").alias("to_paper"), "sim", w.alias("w"))
    best = F.slice(F.sort_array(F.collect_list("sim"), asc=False), 1, k)
    return p.groupBy("from_paper", "to_paper").agg(
        F.count(F.lit(1)).alias("num_chunk_pairs"), F.max("sim").alias("max"), F.avg("sim").alias("mean"), (F.sum(F.col("sim") * F.col("w")) / F.sum("w")).alias("weighted_mean"), best.alias("best"),
    ).withColumn("top_k_mean", F.aggregate("best", F.lit(0.0), lambda s, x: s + x) / F.size("best")).drop("best")


METHODS = ("max", "mean", "weighted_mean", "top_k_mean")


def document_edges(chunk_pairs: DataFrame, method: str, threshold: float) -> DataFrame:
    """src, dst, similarity, num_chunk_pairs, method of document pairs that reach the threshold."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    d = document_similarity(chunk_pairs)
    return d.where(F.col(method) >= threshold).select(F.col("from_paper").alias("src"), F.col("to_paper").alias("dst"), F.col(method).alias("similarity"), "num_chunk_pairs", F.lit(method).alias("method"))


def document_vectors(chunks: DataFrame, rate: float = 0.1) -> DataFrame:
    """paper, dim, value: unit vector of the sum of chunk vectors weighted by exp(-rate * place), weights adding to 1."""
    placed = chunks.select("paper", F.exp(-F.lit(rate) * F.col("chunk_index")).alias("w"), F.posexplode("v").alias("dim", "x"))
    summed = placed.groupBy("paper", "dim").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"))
    norms = summed.groupBy("paper").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    return summed.join(norms, "paper").select("paper", "dim", F.when(F.col("n") > 0, F.col("x") / F.col("n")).alias("value"))


def group_means(vecs: DataFrame, key: str) -> DataFrame:
    """key, dim, value: elementwise mean of v by group."""
    return vecs.select(key, F.posexplode("v").alias("dim", "x")).groupBy(key, "dim").agg(F.avg("x").alias("value"))


def coherence(vecs: DataFrame, key: str) -> DataFrame:
    """key, n, coherence: mean cosine of all pairs of a group's vectors (v), from the sum of its unit vectors; groups of one are left out."""
    u = vecs.where(norm(as_double(F.col("v"))) > 0).select(key, F.posexplode(unit(as_double(F.col("v")))).alias("dim", "x"))
    sums = u.groupBy(key, "dim").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    by = sums.groupBy(key).agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("square"))
    return by.where("n > 1").select(key, "n", ((F.col("square") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("coherence"))
