"""Queries over scores, fits and closed forms."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions import scores as sc
from lattica.operators import graph as g
from lattica.operators import stats as st
from lattica.plans.graph import edges, r6
from lattica.plans.registry import EDGES, PAPERS, SCORES, query
from lattica.sources import tables as tb


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with a flag of having an implementation."""
    s = tb.dimensional_scores(spark, sf_dir)
    i = tb.implementations(spark, sf_dir).withColumn("implemented", F.lit(True))
    return s.join(i, "paper_id", "left").withColumn("implemented", F.coalesce("implemented", F.lit(False)))


FLAGGED = f"{SCORES}, fl AS (SELECT s.*, i.doc_id IS NOT NULL AS implemented FROM scores s LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) i ON i.doc_id = paper_id)"


@query(f"""WITH {FLAGGED}, z AS (SELECT *, CASE WHEN w < 0.5 THEN 'where_zero' WHEN h = 0 THEN 'what_zero' WHEN c = 0 THEN 'conveyance_zero' WHEN t = 0 THEN 'time_zero' ELSE 'control' END AS grp FROM fl)
SELECT grp AS zero_group, count(*) AS n, round(avg(implemented::INTEGER), 6) AS rate FROM z GROUP BY 1""")
def zero_propagation_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = F.when(F.col("w") < 0.5, "where_zero").when(F.col("h") == 0, "what_zero").when(F.col("c") == 0, "conveyance_zero").when(F.col("t") == 0, "time_zero").otherwise("control")
    return _flagged(spark, sf_dir).groupBy(group.alias("zero_group")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("implemented").cast("int")), 6).alias("rate"))


@query(f"WITH {SCORES} SELECT paper_id, round(w * h * c * t, 6) AS information, round((w + h + c + t) / 4, 6) AS additive, round(least(1, w) * least(1, h) * least(1, c) * least(1, t), 6) AS clamped FROM scores")
def information_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = [F.col(x) for x in "whct"]
    return tb.dimensional_scores(spark, sf_dir).select("paper_id", r6(sc.information(*d), "information"), r6(sc.additive(*d), "additive"), r6(sc.clamped_information(F.array(*d)), "clamped"))


@query(f"""WITH {SCORES}, u AS (SELECT primary_category, unnest(['w', 'h', 'c', 't']) AS dimension, unnest([w, h, c, t]) AS x FROM scores), n AS (SELECT count(*) AS n FROM scores)
SELECT primary_category, dimension, count(*) AS zeros, round(100.0::DOUBLE * count(*) / any_value(n), 6) AS percent FROM u, n WHERE x = 0 GROUP BY 1, 2""")
def natural_zeros_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tb.dimensional_scores(spark, sf_dir)
    long = s.unpivot(["primary_category"], ["w", "h", "c", "t"], "dimension", "x").where("x = 0")
    n = s.agg(F.count(F.lit(1)).alias("n"))
    return long.groupBy("primary_category", "dimension").agg(F.count(F.lit(1)).alias("zeros")).crossJoin(F.broadcast(n)).select("primary_category", "dimension", "zeros", F.round(100.0 * F.col("zeros") / F.col("n"), 6).alias("percent"))


@query(f"WITH {SCORES} SELECT count(*) FILTER (least(w, h, c, t) = 0) AS with_zero, count(*) FILTER (c = 0) AS c_zero, count(*) FILTER (t = 0) AS t_zero, count(*) AS n FROM scores")
def zero_dimension_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.dimensional_scores(spark, sf_dir).agg(F.count_if(F.least("w", "h", "c", "t") == 0).alias("with_zero"), F.count_if(F.col("c") == 0).alias("c_zero"), F.count_if(F.col("t") == 0).alias("t_zero"), F.count(F.lit(1)).alias("n"))


def _simpson(to: str, f: str, steps: int = 2000) -> str:
    """SQL of the integral of ``f``, in x, from 0 to ``to``."""
    at = f"({to}) * i / {steps}.0::DOUBLE"
    value = f"list_sum(list_transform(range(0, {steps + 1}), lambda i: CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * {re.sub(r'(?<![a-z_])x(?![a-z_])', at, f)}))"
    return f"(({to}) / {3 * steps}.0::DOUBLE * {value})"


@query(f"""WITH {SCORES}, r AS (SELECT count(*) AS n, corr(w, h) AS wh, corr(w, c) AS wc, corr(w, t) AS wt, corr(h, c) AS hc, corr(h, t) AS ht, corr(c, t) AS ct FROM scores),
u AS (SELECT n, unnest(['w','w','w','h','h','c']) AS a, unnest(['h','c','t','c','t','t']) AS b, unnest([wh, wc, wt, hc, ht, ct]) AS r FROM r)
SELECT a, b, n, round(r, 6) AS r, round(r * sqrt((n - 2) / (1 - r * r)), 4) AS t, round(1 - 2 * exp(lgamma((n - 1) / 2.0::DOUBLE) - lgamma((n - 2) / 2.0::DOUBLE)) / sqrt(pi()) * {_simpson("asin(abs(r))", "pow(cos(x), n - 3)")}, 6) AS p FROM u""")
def dimension_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL takes the probability from an integral: with r the sine of an angle, Student's density is a power of its cosine."""
    return st.correlations(tb.dimensional_scores(spark, sf_dir), ["w", "h", "c", "t"]).select("a", "b", "n", r6("r"), F.round("t", 4).alias("t"), r6("p"))


@query(f"""WITH {SCORES}, x AS (SELECT toxic = 1 AS f, unnest(['additive', 'multiplicative']) AS model, unnest([(w + h + c) / 3, w * h * c]) AS s FROM scores JOIN labels ON doc_id = paper_id),
p AS (SELECT a.model, count(*) AS pairs, sum(CASE WHEN a.s > b.s THEN 1.0::DOUBLE WHEN a.s = b.s THEN 0.5::DOUBLE ELSE 0 END) AS win FROM x a JOIN x b ON a.model = b.model AND a.f AND NOT b.f GROUP BY 1)
SELECT model, round(win / pairs, 6) AS auc FROM p""")
def model_scores_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well additive and multiplicative scores tell toxic papers apart; of one monotone feature the cross-validated AUC is this."""
    s = tb.dimensional_scores(spark, sf_dir).withColumn("flag", F.col("t") == 0)
    d = [F.col(x) for x in "whc"]
    out = [st.auc(s.select(m.alias("s"), "flag"), "s", "flag").select(F.lit(n).alias("model"), r6("auc")) for n, m in (("additive", sc.additive(*d)), ("multiplicative", sc.information(*d)))]
    return out[0].unionByName(out[1])


@query(f"""WITH {FLAGGED}, g AS (SELECT primary_category, count(*) AS n, count(*) FILTER (t = 0) AS k FROM fl GROUP BY 1), a AS (SELECT sum(n) AS tn, sum(k) AS tk FROM g),
x AS (SELECT sum(pow(k - n * tk / tn, 2) / (n * tk / tn) + pow(n - k - n * (tn - tk) / tn, 2) / (n * (tn - tk) / tn)) AS s, count(*) - 1 AS df, sum(n)::BIGINT AS n FROM g, a)
SELECT round(s, 6) AS statistic, df, n, round(1 - 2 / (pow(2, df / 2.0::DOUBLE) * gamma(df / 2.0::DOUBLE)) * {_simpson("sqrt(s)", "pow(x, df - 1) * exp(-x * x / 2)")}, 6) AS p FROM x""")
def chi_square_toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL integrates the density of the statistic's root."""
    s = _flagged(spark, sf_dir).withColumn("flag", F.col("t") == 0)
    return st.chi_square(s, "primary_category", "flag").select(r6("statistic"), "df", "n", r6("p"))


#: What an order's lines keep of their price after the discount, and after a part of the tax too.
ORDER_POINTS = "o AS (SELECT l_orderkey AS src, 0 AS dst, avg(1 - l_discount) AS c, avg((1 - l_discount) * (1 - l_tax / 4)) AS y FROM lineitem GROUP BY 1)"


def _order_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = tb.table(spark, sf_dir, "lineitem")
    kept = 1 - F.col("l_discount")
    return li.groupBy(F.col("l_orderkey").alias("src"), F.lit(0).alias("dst")).agg(F.avg(kept).alias("c"), F.avg(kept * (1 - F.col("l_tax") / 4)).alias("y"))


def _edge_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges, by their context before and after amplification."""
    return g.amplified(edges(spark, sf_dir)).select("src", "dst", F.col("context_original").alias("c"), F.col("context_amplified").alias("y"))


_LOG_RATIO = "count(*) AS n, round(avg(r), 6) AS alpha, round(stddev_pop(r), 6) AS sd"


@query(f"""WITH {EDGES}, {ORDER_POINTS}, re AS (SELECT ln(pow(sim, 1.5)) / ln(sim) AS r FROM edges WHERE sim > 0.1 AND sim <> 1), ro AS (SELECT ln(y) / ln(c) AS r FROM o WHERE c > 0.1 AND y > 0 AND c <> 1)
SELECT 'edges' AS points, {_LOG_RATIO} FROM re WHERE r > 0.5 AND r < 2 UNION ALL SELECT 'orders', {_LOG_RATIO} FROM ro WHERE r > 0.5 AND r < 2""")
def alpha_log_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean power of all edges' amplification, which is the one set, and that by which orders' prices after discount and tax follow those after discount alone."""
    out = [st.log_ratio_alpha(p(spark, sf_dir), "c", "y").select(F.lit(n).alias("points"), "n", r6("alpha"), r6("sd")) for n, p in (("edges", _edge_points), ("orders", _order_points))]
    return out[0].unionByName(out[1])


GRID = "(SELECT 1.0 + i * (1.0::DOUBLE / 99) AS alpha FROM range(0, 100) x(i))"


@query(f"""WITH {EDGES} SELECT round(alpha, 6) AS alpha, round(avg(pow(sim - sim * pow(sim, alpha), 2)), 6) AS mse, round(1 - avg(pow(sim - sim * pow(sim, alpha), 2)) / var_pop(sim), 4) AS r2 FROM edges, {GRID} GROUP BY alpha""")
def alpha_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error falls with alpha towards the lower bound, since the target is the input; ``alpha_fit`` has a target of its own."""
    e = edges(spark, sf_dir)
    return st.alpha_grid(e, "sim", "sim", "sim", 1.0, 2.0, 100).select(r6("alpha"), r6("mse"), F.round("r2", 4).alias("r2"))


def _alpha_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with a target that is not a power of the context: orders' discounted prices by discount."""
    li = tb.table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_returnflag").alias("grp"), (1 - F.col("l_discount")).alias("c"), (F.col("l_quantity") / 50).alias("b"), (F.col("l_quantity") / 50 * (1 - F.col("l_discount")) * (1 - F.col("l_tax") / 4)).alias("y"))


def _refined(rounds: int = 4, steps: int = 41, low: float = 0.5, high: float = 3.0) -> str:
    """SQL of the rounds of a refined grid, r1 and on, over points p and groups s."""
    spread, out = (high - low) / 2, [f"r0 AS (SELECT grp, {(low + high) / 2}::DOUBLE AS mid FROM s)"]
    for k in range(1, rounds + 1):
        step = 2 * spread / (steps - 1)
        at = f"greatest({low}::DOUBLE, least({high}::DOUBLE, mid - {spread!r}::DOUBLE + i * {step!r}::DOUBLE))"
        errors = f"SELECT grp, a, avg(pow(y - b * pow(c, a), 2)) AS e FROM p JOIN (SELECT DISTINCT grp, {at} AS a FROM r{k - 1}, range({steps}) t(i)) USING (grp) GROUP BY 1, 2"
        out.append(f"r{k} AS (SELECT grp, arg_min(a, e) AS mid, min(e) AS mse FROM ({errors}) GROUP BY 1)")
        spread = step
    return ", ".join(out)


@query(f"""WITH p AS (SELECT l_returnflag AS grp, 1 - l_discount AS c, l_quantity / 50 AS b, l_quantity / 50 * (1 - l_discount) * (1 - l_tax / 4) AS y FROM lineitem),
s AS (SELECT grp, count(*) AS n, var_pop(y) AS v FROM p GROUP BY 1 HAVING count(*) > 20), {_refined()}
SELECT grp, n, round(mid, 4) AS alpha, round(mse, 6) AS mse, round(1 - mse / v, 4) AS r2 FROM r4 JOIN s USING (grp)""")
def alpha_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = st.fit_alpha(_alpha_points(spark, sf_dir), "c", "b", "y", keys=["grp"], least=20)
    return f.select("grp", "n", F.round("alpha", 4).alias("alpha"), r6("mse"), F.round("r2", 4).alias("r2"))


@query(f"""WITH {EDGES}, {ORDER_POINTS}, r AS (SELECT 'edges' AS points, src, dst, ln(pow(sim, 1.5)) / ln(sim) AS r FROM edges WHERE sim > 0.1 AND sim <> 1 UNION ALL SELECT 'orders', src, dst, ln(y) / ln(c) FROM o WHERE c > 0.1 AND y > 0 AND c <> 1),
u AS (SELECT points, i, r, ('0x' || substr(md5('42:' || src || ':' || dst || ':' || i), 1, 13))::BIGINT / {float(1 << 52)}::DOUBLE AS u FROM r, range(1, 201) t(i)),
w AS (SELECT points, i, r, len(list_filter({st.POISSON_CUTS}::DOUBLE[], lambda c: u > c)) AS w FROM u), m AS (SELECT points, sum(w * r) / sum(w) AS m FROM w GROUP BY points, i)
SELECT points, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.5), 6) AS alpha, round(quantile_cont(m, 0.975), 6) AS high FROM (SELECT unnest(['edges', 'orders']) AS points) LEFT JOIN m USING (points) GROUP BY points""")
def alpha_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far those mean powers spread over resampled edges, which share one power, and over resampled orders."""
    out = [st.bootstrap_alpha(p(spark, sf_dir), "c", "y", deal=n == "orders").select(F.lit(n).alias("points"), r6("low"), r6("alpha"), r6("high")) for n, p in (("edges", _edge_points), ("orders", _order_points))]
    return out[0].unionByName(out[1])


@query(f"""WITH {EDGES}, p AS (SELECT sim AS c, pow(sim, 1.5) AS a, lag(pow(sim, 1.5)) OVER (ORDER BY sim, pow(sim, 1.5)) AS b FROM edges)
SELECT count(*) AS n, count(*) FILTER (a < b) AS drops, (min(a) >= 0 AND max(a) <= 1) AS bounded, round(avg(pow(a - pow(c, 1.4), 2)), 8) AS mse FROM p""")
def fit_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = g.amplified(edges(spark, sf_dir)).select("context_original", "context_amplified")
    bounded = ((F.min("context_amplified") >= 0) & (F.max("context_amplified") <= 1)).alias("bounded")
    mse = F.round(F.avg((F.col("context_amplified") - F.pow("context_original", F.lit(1.4))) ** 2), 8).alias("mse")
    return st.inversions_of(e, "context_original", sc.amplify, bounded, mse).select("n", "drops", "bounded", "mse")


@query(f"""WITH {EDGES}, m AS (SELECT count(*) AS n, avg(a) AS mu, min(a) AS lo, max(a) AS hi, median(a) AS md FROM (SELECT pow(sim, 1.5) AS a FROM edges)),
s AS (SELECT any_value(n) AS n, any_value(lo) AS lo, any_value(hi) AS hi, any_value(mu) AS mu, any_value(md) AS md, avg(pow(a - mu, 2)) AS m2, avg(pow(a - mu, 3)) AS m3, avg(pow(a - mu, 4)) AS m4 FROM (SELECT pow(sim, 1.5) AS a FROM edges), m)
SELECT n, round(lo, 6) AS least, round(hi, 6) AS most, round(mu, 6) AS mean, round(md, 6) AS median, round(m3 / pow(m2, 1.5), 4) AS skewness, round(m4 / (m2 * m2) - 3, 4) AS kurtosis FROM s""")
def amplification_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = st.moments(g.amplified(edges(spark, sf_dir)), "context_amplified")
    return m.select("n", r6("least"), r6("most"), r6("mean"), r6("median"), F.round("skewness", 4).alias("skewness"), F.round("kurtosis", 4).alias("kurtosis"))


@query("""WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n DESC, user_id) AS rank FROM c)
SELECT count(*) AS n, round(regr_slope(ln(n), ln(rank)), 6) AS slope, round(regr_intercept(ln(n), ln(rank)), 6) AS intercept, round(regr_r2(ln(n), ln(rank)), 6) AS r2 FROM r""")
def power_law_rank_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tb.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    f = st.rank_fit(c.withColumnRenamed("n", "k"), "k", "user_id")
    return f.select("n", r6("slope"), r6("intercept"), r6("r2"))


@query("""WITH c AS (SELECT event_type, user_id, count(*) AS k FROM events GROUP BY 1, 2), t AS (SELECT event_type, sum(k) AS t, count(*) AS classes FROM c GROUP BY 1)
SELECT event_type, classes, round(sum(-(k / t) * log2(k / t)), 6) AS entropy, round(sum(-(k / t) * log2(k / t)) / log2(classes), 6) AS normalized FROM c JOIN t USING (event_type) GROUP BY 1, 2""")
def normalized_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tb.table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("k"))
    return st.entropy(c, "event_type", "k").select("event_type", "classes", r6("entropy"), r6("normalized"))


@query("""WITH d AS (SELECT event_type, date_diff('day', DATE '2024-01-01', ts::DATE) AS t, avg(value) AS v FROM events GROUP BY 1, 2), f AS (SELECT event_type, -regr_slope(ln(v), t) AS rate, exp(regr_intercept(ln(v), t)) AS v0 FROM d WHERE v > 0 GROUP BY 1)
SELECT event_type, round(rate, 6) AS rate, round(CASE WHEN rate > 0 THEN ln(2) / rate END, 3) AS half_life, round(v0 * exp(-rate * 30), 4) AS at_30, v0 * exp(-rate * 30) < 1 AS collapsed FROM f""")
def decay_half_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    d = tb.table(spark, sf_dir, "events").groupBy("event_type", day.alias("t")).agg(F.avg("value").alias("v")).where("v > 0")
    f = d.groupBy("event_type").agg((-F.regr_slope(F.ln("v"), F.col("t"))).alias("rate"), F.exp(F.regr_intercept(F.ln("v"), F.col("t"))).alias("v0"))
    left = sc.decayed(F.col("v0"), F.col("rate"), F.lit(30))
    return f.select("event_type", r6("rate"), F.round(sc.half_life(F.col("rate")), 3).alias("half_life"), F.round(left, 4).alias("at_30"), (left < 1).alias("collapsed"))


@query("""WITH d AS (SELECT l_returnflag AS grp, l_linenumber AS step, avg(l_discount) AS risk FROM lineitem GROUP BY 1, 2), s AS (SELECT grp, step, exp(sum(ln(1 - risk)) OVER (PARTITION BY grp ORDER BY step)) AS p FROM d)
SELECT grp, round(min(p), 6) AS survival, min(step) FILTER (p < 0.9)::INTEGER AS first_below FROM s GROUP BY 1""")
def survival_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tb.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("grp"), F.col("l_linenumber").alias("step")).agg(F.avg("l_discount").alias("risk"))
    lists = d.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("step", "risk"))).alias("l"))
    upto = lists.select("grp", F.posexplode("l").alias("i", "e"), "l").select("grp", "e.step", sc.survival(F.transform(F.slice("l", 1, F.col("i") + 1), lambda x: x["risk"])).alias("p"))
    return upto.groupBy("grp").agg(F.round(F.min("p"), 6).alias("survival"), F.min(F.when(F.col("p") < 0.9, F.col("step"))).cast("int").alias("first_below"))


@query(f"""WITH {FLAGGED}, gr AS (SELECT 1.0 + 0.1 * i AS alpha FROM range(0, 20) x(i)), p AS (SELECT alpha, h * pow(c * 0.5 + 0.4, alpha) AS s, implemented AS f FROM fl, gr),
m AS (SELECT alpha, quantile_cont(s, 0.5) AS md FROM p GROUP BY 1) SELECT round(alpha::DOUBLE, 6) AS alpha, round(avg(((s > md) = f)::INTEGER), 6) AS accuracy FROM p JOIN m USING (alpha) GROUP BY alpha""")
def optimal_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of a median cut of amplified scores, over a grid of alphas."""
    grid = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.lit(1.0) + i * 0.1)
    p = _flagged(spark, sf_dir).select("h", "c", "implemented", F.explode(grid).alias("alpha"))
    p = p.withColumn("s", F.col("h") * F.pow(F.col("c") * 0.5 + 0.4, "alpha"))
    m = p.groupBy("alpha").agg(F.percentile("s", F.lit(0.5)).alias("md"))
    return p.join(m, "alpha").groupBy("alpha").agg(F.avg(((F.col("s") > F.col("md")) == F.col("implemented")).cast("int")).alias("a")).select(r6("alpha"), r6("a", "accuracy"))


CASES = "(VALUES (1, 0.5, 0.8, 0.9, 0.7), (2, 0.0, 0.8, 0.9, 0.7), (3, 0.5, 0.0, 0.9, 0.7), (4, 0.5, 0.8, 0.0, 0.7), (5, 0.5, 0.8, 0.9, 0.0), (6, 0.1, 10.0, 1.0, 1.0), (7, 0.1, 0.9, 0.9, 0.9))"


@query(f"""SELECT k, round(w * h * c * t, 6) AS product, round(least(1, w) * least(1, h) * least(1, c) * least(1, t), 6) AS clamped, round((w + h + c + t) / 4, 6) AS mean, (w * h * c * t = 0) = (w = 0 OR h = 0 OR c = 0 OR t = 0) AS propagates
FROM (SELECT k, w::DOUBLE AS w, h::DOUBLE AS h, c::DOUBLE AS c, t::DOUBLE AS t FROM {CASES} v(k, w, h, c, t))""")
def zero_propagation_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.sql(f"SELECT k, double(w) AS w, double(h) AS h, double(c) AS c, double(t) AS t FROM VALUES {CASES[8:-1]} AS v(k, w, h, c, t)")
    d = [F.col(x) for x in "whct"]
    some = (F.col("w") == 0) | (F.col("h") == 0) | (F.col("c") == 0) | (F.col("t") == 0)
    return v.select("k", r6(sc.information(*d), "product"), r6(sc.clamped_information(F.array(*d)), "clamped"), r6(sc.additive(*d), "mean"), ((sc.information(*d) == 0) == some).alias("propagates"))


@query("""WITH g AS (SELECT a, i / 100.0::DOUBLE AS x, pow(i / 100.0::DOUBLE, a) AS y FROM (SELECT unnest([1.0, 1.5, 1.8, 2.0])::DOUBLE AS a), range(0, 101) r(i)), l AS (SELECT *, lag(y) OVER (PARTITION BY a ORDER BY x) AS b FROM g)
SELECT a AS alpha, round(min(y), 6) AS least, round(max(y), 6) AS most, count(*) FILTER (y < b) AS drops, round((1 - pow(0.999999, a)) / 0.000001, 3) AS slope_at_1 FROM l GROUP BY 1""")
def amplification_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    gr = spark.range(101).select((F.col("id") / 100.0).alias("x"), F.explode(F.array(*map(F.lit, [1.0, 1.5, 1.8, 2.0]))).alias("alpha")).withColumn("y", sc.amplify(F.col("x"), F.col("alpha")))
    gr = gr.withColumn("b", F.lag("y").over(Window.partitionBy("alpha").orderBy("x")))
    slope = (1 - F.pow(F.lit(0.999999), F.col("alpha"))) / 0.000001
    return gr.groupBy("alpha").agg(F.round(F.min("y"), 6).alias("least"), F.round(F.max("y"), 6).alias("most"), F.count_if(F.col("y") < F.col("b")).alias("drops")).withColumn("slope_at_1", F.round(slope, 3))


GROUND = "(1, 0.9, 0.1), (2, 0.9, 0.8), (3, 0.3, 0.9)"


@query(f"SELECT k, round(0.5 * pow(ctx, 1.5) * g, 6) AS conveyed, round(0.5 * pow(ctx, 1.5) * g * g, 6) AS actionable, round(1 - g, 6) AS entropy FROM (SELECT k, ctx::DOUBLE AS ctx, g::DOUBLE AS g FROM (VALUES {GROUND}) v(k, ctx, g))")
def grounding_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.sql(f"SELECT k, double(ctx) AS ctx, double(g) AS g FROM VALUES {GROUND} AS v(k, ctx, g)")
    c = sc.conveyance(F.lit(0.5), F.col("ctx"), F.col("g"))
    return v.select("k", r6(c, "conveyed"), r6(sc.actionable(c, F.col("g")), "actionable"), r6(1 - F.col("g"), "entropy"))


@query("""WITH RECURSIVE b AS (SELECT (i / 10.0)::DOUBLE AS base FROM range(1, 10) r(i)), f AS (SELECT base, 0 AS n, base AS f FROM b UNION ALL SELECT base, n + 1, base * (1 + 0.8 * f) / 2 FROM f WHERE n < 10)
SELECT base, round(f, 6) AS value FROM f WHERE n = 10""")
def recursive_conveyance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1, 10).select((F.col("id") / 10.0).alias("base")).select("base", r6(sc.recursive_conveyance(F.col("base"), F.lit(0.8)), "value"))


@query("""SELECT t::BIGINT AS t, round((1 - exp(-t / 40.0::DOUBLE)) * tanh(t / 60.0::DOUBLE), 6) AS growth, round(t / (t + 20.0::DOUBLE), 6) AS share FROM range(1, 101) r(t)""")
def convergence_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    return spark.range(1, 101).withColumnRenamed("id", "t").select("t", r6((1 - F.exp(-t / 40.0)) * F.tanh(t / 60.0), "growth"), r6(t / (t + 20.0), "share"))


@query("SELECT n, eps, round(4 * ln(n) / (eps * eps / 2 - eps * eps * eps / 3), 2) AS dims FROM (SELECT unnest([1000, 100000, 10000000])::DOUBLE AS n), (SELECT unnest([0.1, 0.2, 0.5])::DOUBLE AS eps)")
def least_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.range(1).select(F.explode(F.array(*map(F.lit, [1e3, 1e5, 1e7]))).alias("n")).select("n", F.explode(F.array(*map(F.lit, [0.1, 0.2, 0.5]))).alias("eps"))
    return v.select("n", "eps", F.round(sc.least_dimensions(F.col("n"), F.col("eps")), 2).alias("dims"))


_SIGNS = lambda signs: " OR ".join(f"contains(low, '{s}')" for s in signs)


@query(f"""WITH d AS (SELECT doc_id, lower(text) AS low FROM documents) SELECT doc_id, round({" + ".join(f"CASE WHEN {_SIGNS(s)} THEN {p}.0::DOUBLE ELSE 0 END" for p, s in ((sc.GROUNDING[n], sc.GROUNDING_SIGNS[n]) for n in sc.GROUNDING))}, 6) / 200 AS grounding,
round(least(1.0::DOUBLE, {" + ".join(f"CASE WHEN {_SIGNS(s)} THEN {w}::DOUBLE ELSE 0 END" for w, s in sc.CONTEXT_SIGNS.values())}), 6) AS context FROM d""")
def conveyance_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.table(spark, sf_dir, "documents").select("doc_id", sc.grounding(F.col("text")).alias("grounding"), r6(sc.context_from_text(F.col("text")), "context"))


@query(f"WITH {PAPERS} SELECT paper_id, round(0.15::DOUBLE * 0.8 * contains(body, '$')::INTEGER + 0.20 * 0.8 * (length(body) > 1000)::INTEGER + 0.25 * 0.9 * (len(categories) > 1)::INTEGER, 6) AS score, round(least(1.0::DOUBLE, 0.5 * pow(0.15::DOUBLE * 0.8 * contains(body, '$')::INTEGER + 0.20 * 0.8 * (length(body) > 1000)::INTEGER + 0.25 * 0.9 * (len(categories) > 1)::INTEGER, 1.5)), 6) AS conveyed FROM papers")
def element_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tb.papers(spark, sf_dir)
    s = sc.context_from_elements({"mathematical_formulas": F.col("body").contains("$"), "examples": F.length("body") > 1000, "pseudocode": F.size("categories") > 1}, {"pseudocode": F.lit(0.9)})
    return p.select("paper_id", r6(s, "score"), r6(sc.capped_conveyance(F.lit(0.5), s), "conveyed"))


@query()
def variance_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions that hold 95 % of the variance of all embeddings, and the first shares."""
    _, _, shares = st.principal_components(tb.vectors(spark, sf_dir), "v", 2)
    return spark.createDataFrame([(st.dims_for_variance(shares), float(round(shares[0], 6)))], "n95 int, first double")


@query("""WITH RECURSIVE x AS (SELECT vec_id, unnest(range(0, 64)) AS d, unnest(embedding::DOUBLE[]) AS x FROM embeddings), m AS (SELECT a.d, list(c ORDER BY e) AS row, sum(c) FILTER (a.d = e) AS own FROM (SELECT a.d AS d, b.d AS e, covar_pop(a.x, b.x) AS c FROM x a JOIN x b USING (vec_id) GROUP BY 1, 2) a GROUP BY a.d),
c AS (SELECT list(row ORDER BY d) AS c, sum(own) AS total FROM m), it AS (SELECT 0 AS i, list_transform(range(0, 64), lambda k: 1.0::DOUBLE + k % 7) AS v UNION ALL
  SELECT i + 1, list_transform(y, lambda z: z / sqrt(list_dot_product(y, y))) FROM (SELECT i, list_transform(c, lambda r: list_dot_product(r, v)) AS y FROM it, c WHERE i < 1000)),
e AS (SELECT v, c, total FROM it, c WHERE i = 1000)
SELECT 1 AS component, round(list_dot_product(v, list_transform(c, lambda r: list_dot_product(r, v))) / total, 6) AS share FROM e""")
def leading_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of variance of the first component, found without a matrix of d x d; the SQL goes by powers of the covariance."""
    _, _, shares = st.leading_components(tb.vectors(spark, sf_dir), "v", 1)
    return spark.createDataFrame([(1, round(float(shares[0]), 6))], "component int, share double")


@query()
def landscape_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density of all embeddings over their first two principal components."""
    v = tb.vectors(spark, sf_dir)
    mean, comps, _ = st.principal_components(v, "v", 2)
    p = st.project(v, "v", mean, comps).select(F.col("coords")[0].alias("x"), F.col("coords")[1].alias("y"))
    return st.density(p, "x", "y").withColumn("density", F.round("density", 6))
