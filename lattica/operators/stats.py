"""Statistics over tables: fits, correlations, tests, moments, grids. Sums are made by the cluster, closed forms at the end."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lattica.operators.ordered import ranked, running_sum, with_previous
from lattica.sources.scratch import settle


def log_ratio_alpha(edges: DataFrame, original: str, amplified: str) -> DataFrame:
    """n, mean, sd of ln(amplified) / ln(original) where original > 0.1, amplified > 0 and the ratio is within 0.5 and 2."""
    o, a = F.col(original), F.col(amplified)
    ratio = F.ln(a) / F.ln(o)
    ok = edges.where((o > 0.1) & (a > 0) & (o != 1)).select(ratio.alias("r")).where((F.col("r") > 0.5) & (F.col("r") < 2))
    return ok.agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("alpha"), F.stddev_pop("r").alias("sd"))


def alpha_grid(points: DataFrame, context: str, base: str, target: str, low: float, high: float, steps: int) -> DataFrame:
    """alpha, mse, r2 of base * context ** alpha against target, on an even grid. All grid points share one pass, each as a sum of its own; no row is expanded."""
    step = (high - low) / (steps - 1)
    y, b, c = F.col(target), F.col(base), F.col(context)
    at = [low + i * step for i in range(steps)]
    one = points.agg(F.var_pop(y).alias("v"), *[F.avg((y - b * F.pow(c, F.lit(a))) ** 2).alias(f"e{i}") for i, a in enumerate(at)])
    return one.select("v", F.inline(F.array(*[F.struct(F.lit(a).alias("alpha"), F.col(f"e{i}").alias("mse")) for i, a in enumerate(at)]))).select("alpha", "mse", F.when(F.col("v") > 0, 1 - F.col("mse") / F.col("v")).alias("r2"))


def best_alpha(points: DataFrame, context: str, base: str, target: str, low: float = 0.5, high: float = 3.0, steps: int = 100) -> DataFrame:
    """The grid row of least error, the smallest alpha of equals."""
    return alpha_grid(points, context, base, target, low, high, steps).orderBy("mse", "alpha").limit(1)


def fit_alpha(points: DataFrame, context: str, base: str, target: str, low: float = 0.5, high: float = 3.0, rounds: int = 4, steps: int = 41, keys: list[str] | None = None, least: int = 0) -> DataFrame:
    """keys, n, alpha, mse, r2: the least-squares alpha of each group with more than ``least`` points.

    A grid is refined around its best point, ``rounds`` times; every round is one aggregation for all groups, so a
    group of any size is only ever summed.
    """
    keys = keys or []
    p = points.select(*keys, F.col(context).alias("c"), F.col(base).alias("b"), F.col(target).alias("y")).where("c IS NOT NULL AND b IS NOT NULL AND y IS NOT NULL")
    stats = p.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.var_pop("y").alias("v")).where(F.col("n") > least)
    spread = (high - low) / 2
    centre = stats.select(*keys, F.lit((low + high) / 2).alias("mid"))
    p = settle(p, "points")
    for _ in range(rounds):
        step = 2 * spread / (steps - 1)
        at = [F.greatest(F.lit(low), F.least(F.lit(high), F.col("mid") - spread + i * step)) for i in range(steps)]
        wide = p.join(centre, keys) if keys else p.crossJoin(F.broadcast(centre))
        sums = wide.groupBy(*keys).agg(F.first("mid").alias("mid"), *[F.avg((F.col("y") - F.col("b") * F.pow("c", a)) ** 2).alias(f"e{i}") for i, a in enumerate(at)])
        best = F.array_min(F.array(*[F.struct(F.col(f"e{i}").alias("mse"), a.alias("alpha")) for i, a in enumerate(at)]))
        by = sums.select(*keys, best.alias("best")).select(*keys, F.col("best.alpha").alias("mid"), F.col("best.mse").alias("mse"))
        centre, spread = by.select(*keys, "mid"), step
    out = by.join(stats, keys) if keys else by.crossJoin(stats)
    return out.select(*keys, "n", F.col("mid").alias("alpha"), "mse", F.when(F.col("v") > 0, 1 - F.col("mse") / F.col("v")).alias("r2"))


#: Shares of draws from a Poisson distribution of mean 1 that are at most 0, 1, ... 6.
POISSON_CUTS = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(7)]).tolist()


def bootstrap_alpha(edges: DataFrame, original: str, amplified: str, rounds: int = 200, seed: int = 42, deal: bool = True) -> DataFrame:
    """low, alpha, high: 2.5, 50 and 97.5 percentiles of the mean log ratio over Poisson resamples; weights come from MD5 hashes, so runs and engines agree.

    A resample that draws no point has no mean; NaN stands for it. ``deal`` exchanges the points first, which few files
    need; points that are made by many tasks are drawn where they are made.
    """
    ok = edges.where((F.col(original) > 0.1) & (F.col(amplified) > 0) & (F.col(original) != 1)).select(F.concat(F.lit(f"{seed}:"), F.col("src").cast("string"), F.lit(":"), F.col("dst").cast("string"), F.lit(":")).alias("key"), (F.ln(amplified) / F.ln(original)).alias("r"))
    # Few bytes make many draws, so points are dealt out to all tasks before they are drawn.
    spark = edges.sparkSession
    ok = ok if not deal else ok.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "key")
    # Inverse transform of a Poisson(1) from a hash in [0, 1), its first 13 hex digits: texts of one length are in the order of their numbers.
    digest = F.md5(F.concat("key", F.col("round").cast("string")).cast("binary"))
    weight = F.when(F.col("digest").isNull(), 0)
    for k, c in enumerate(POISSON_CUTS):
        weight = weight.when(F.col("digest") <= f"{int(c * (1 << 52)):013x}" + "f" * 19, k)
    w = ok.select("*", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")).withColumn("digest", digest).withColumn("w", weight.otherwise(len(POISSON_CUTS)))
    mean = F.when(F.sum("w") > 0, F.sum(F.col("w") * F.col("r")) / F.sum("w")).otherwise(float("nan"))
    means = w.groupBy("round").agg(mean.alias("m"))
    return means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.5)).alias("alpha"), F.percentile("m", F.lit(0.975)).alias("high"))


#: Values that are few enough to be put in order, and cells of the counts that lead to them.
FEW, COUNTED = 1 << 20, 1 << 14


def percentile(df: DataFrame, column: str, share: float, name: str = "percentile", known: tuple[int, float, float] | None = None) -> DataFrame:
    """The exact percentile, between neighbours by share, as one row. ``known`` are the number of values, the least and the most.

    Values are counted by cells of their range, again and again, until the cells that hold the place have few; only
    those are put in order. The rows are made anew for each count, and no more than counts are exchanged.
    """
    x = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    n, lo, hi = known or x.agg(F.count(F.lit(1)), F.min("x"), F.max("x")).first()
    if not n:
        return df.sparkSession.createDataFrame([(None,)], f"{name} double")
    place = (n - 1) * share
    first, last = math.floor(place), math.ceil(place)
    below, held = 0, n
    while held > FEW and lo < hi and math.isfinite(hi - lo):
        at = F.least(F.lit(COUNTED - 1), F.floor((F.col("x") - F.lit(lo)) / F.lit(hi - lo) * COUNTED))
        by = x.where(F.col("x").between(lo, hi)).groupBy(at.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        before, now = below, None
        for c in by.orderBy("cell").collect():
            if now is None and before + c["n"] > first:
                now = [before, 0, c["lo"], c["hi"]]
            if now is not None:
                now[1] += c["n"]
                now[3] = c["hi"]
            before += c["n"]
            if before > last:
                break
        if now[1] == held:
            break
        below, held, lo, hi = now
    if lo == hi:
        return df.sparkSession.createDataFrame([(float(lo),)], f"{name} double")
    held_x = x.where(F.col("x").between(lo, hi))
    near = ranked(settle(held_x, "few") if held <= FEW else held_x, [F.col("x")]).where(F.col("rank").isin(first - below + 1, last - below + 1))
    above = place - first
    return near.agg((F.min("x") * (1 - above) + F.max("x") * above).alias(name))


def moments(df: DataFrame, column: str) -> DataFrame:
    """n, least, most, mean, median, skewness and excess kurtosis (population), and the Jarque-Bera statistic."""
    x = F.col(column)
    one = settle(df.agg(F.count(x).alias("n"), F.min(x).alias("least"), F.max(x).alias("most"), F.avg(x).alias("mean"), F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis")), "moments")
    return one.crossJoin(percentile(df, column, 0.5, "median", one.select("n", F.col("least").cast("double"), F.col("most").cast("double")).first())).withColumn("jarque_bera", F.col("n") / 6 * (F.col("skewness") ** 2 + F.col("kurtosis") ** 2 / 4))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r, t, n and the two-sided probability p for each pair of columns; one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.corr(a, b).alias(f"{a}_{b}") for a, b in pairs])
    rows = F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}_{b}").alias("r")) for a, b in pairs]))
    r = F.col("r")
    told = one.select("n", rows).withColumn("t", F.when(F.abs(r) < 1, r * F.sqrt((F.col("n") - 2) / (1 - r * r))))
    return told.withColumn("p", _student("t", F.col("n") - 2))


def beta_share(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or 1e-300)
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or 1e-300)
            c = (1 + num / c) or 1e-300
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return out * math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a


def two_sided_p(t: float, df: float) -> float:
    """Two-sided probability of Student's t."""
    return beta_share(df / (df + t * t), df / 2, 0.5)


def f_upper_p(f: float, df1: float, df2: float) -> float:
    """Upper probability of F."""
    return beta_share(df2 / (df2 + df1 * f), df2 / 2, df1 / 2)


def chi_square_p(x: float, df: int) -> float:
    """Upper probability of chi-square, by the incomplete gamma function."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for n in range(1, 500):
            term *= x / (a + n)
            total += term
        return 1 - front * total
    c, d = 1e300, 1 / (x + 1 - a)
    out = d
    for n in range(1, 500):
        num, den = n * (a - n), x + 2 * n + 1 - a
        d = 1 / (num * d + den)
        c = den + num / c
        out *= c * d
    return front * out


@F.pandas_udf(DoubleType())
def _student(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) or n < 1 else two_sided_p(x, n) for x, n in zip(t, df, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def _chi_square(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) or n < 1 else chi_square_p(v, n) for v, n in zip(x, df, strict=True)], dtype="float64")


def chi_square(df: DataFrame, group: str, flag: str) -> DataFrame:
    """statistic, df, n and probability p of independence of group and flag; null where a count is expected to be 0."""
    by = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(flag)).alias("k"))
    total = df.agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col(flag)).alias("tk"))
    x = by.crossJoin(F.broadcast(total))
    e1, e0 = F.col("n") * F.col("tk") / F.col("t"), F.col("n") * (F.col("t") - F.col("tk")) / F.col("t")
    part = F.when((e1 > 0) & (e0 > 0), (F.col("k") - e1) ** 2 / e1 + (F.col("n") - F.col("k") - e0) ** 2 / e0)
    return x.agg(F.when(F.count(part) == F.count(F.lit(1)), F.sum(part)).alias("statistic"), (F.count(F.lit(1)) - 1).alias("df"), F.sum("n").alias("n")).withColumn("p", _chi_square("statistic", F.col("df")))


def auc(df: DataFrame, score: str, flag: str) -> DataFrame:
    """n, positives, auc: the chance that a positive row scores above a negative one, ties half.

    Scores are counted first; the running count then goes over distinct scores, not rows.
    """
    by = df.groupBy(score).agg(F.count_if(F.col(flag)).alias("p"), F.count_if(~F.col(flag)).alias("q"))
    x = running_sum(by, [F.col(score)], "q", "below")
    return x.agg(F.sum(F.col("p") + F.col("q")).alias("n"), F.sum("p").alias("positives"), (F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)) / (F.sum("p") * F.sum("q"))).alias("auc"))


def auc_by(df: DataFrame, score: str, flag: str, group: str) -> DataFrame:
    """group, auc of each group, ties half, null where a group has one label only; scores are counted first, so a window goes over the distinct scores of a group."""
    by = df.groupBy(group, score).agg(F.count_if(F.col(flag)).alias("p"), F.count_if(~F.col(flag)).alias("q"))
    w = Window.partitionBy(group).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    x = by.withColumn("below", F.coalesce(F.sum("q").over(w), F.lit(0)))
    return x.groupBy(group).agg(F.try_divide(F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)), F.sum("p") * F.sum("q")).alias("auc"))


def rank_fit(counts: DataFrame, count: str, key: str) -> DataFrame:
    """n, slope, intercept, r2 of ln(count) against ln(rank); ranks by falling count, then key."""
    r = ranked(counts.where(F.col(count) > 0).withColumn("_falling", -F.col(count)), [F.col("_falling"), F.col(key)])
    y, x = F.ln(count), F.ln("rank")
    return r.agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def inversions(df: DataFrame, order: str, value: str) -> DataFrame:
    """n, drops: neighbours by ``order`` whose value falls."""
    x = with_previous(df.select(F.col(order).alias("o"), F.col(value).alias("v")), [F.col("o"), F.col("v")], "v", "b")
    return x.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") < F.col("b")).alias("drops"))


#: Parts in which values are put in order, values that are packed together, and rows of a batch.
SORTED_PARTS, PACKED, EMITTED = 2048, 1 << 20, 1 << 18


def _packed(x: np.ndarray) -> bytes:
    """Doubles in order, as the planes of bytes of their steps: the upper planes are nearly all zero, which compresses."""
    return np.diff(x.view(np.int64), prepend=np.int64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.int64).ravel()).view(np.float64)


def inversions_of(df: DataFrame, order: str, value: Callable[[Column], Column], *more: Column) -> DataFrame:
    """n, drops, and the aggregates ``more``: as ``inversions``, where the value is a function of the order column.

    Only the order's own values are exchanged, each once a chunk and packed, in parts by their quantiles; equal ones
    have equal values and make no drop.
    """
    x = df.where(F.col(order).isNotNull()).select(F.col(order).cast("double").alias("o"))
    cuts = F.percentile_approx(F.col(order).cast("double"), [i / SORTED_PARTS for i in range(1, SORTED_PARTS)], 4 * SORTED_PARTS)
    one = settle(df.agg(F.count(F.lit(1)).alias("n"), cuts.alias("cuts"), *more), "cuts")
    bounds = np.unique(np.array(one.select("cuts").first()[0] or [], np.float64))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            v = np.unique(np.concatenate(held))
            at = np.searchsorted(bounds, v, "right")
            first = np.flatnonzero(np.diff(at, prepend=-1))
            return pa.RecordBatch.from_arrays([pa.array(at[first].astype(np.int32)), pa.array([_packed(c) for c in np.split(v, first[1:])], pa.binary())], ["part", "o"])

        held, n = [], 0
        for b in batches:
            # Adding 0 makes one zero of both, whose bits differ.
            held.append(b.column(0).to_numpy(zero_copy_only=False) + 0.0)
            n += b.num_rows
            if n >= PACKED:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for b in batches:
            part = b.column("part")[0]
            held += [_unpacked(o) for o in b.column("o").to_pylist()]
        v = np.unique(np.concatenate(held))
        before = np.concatenate([[np.nan], v[:-1]])
        for k in range(0, len(v), EMITTED):
            o = v[k : k + EMITTED]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(o), part.as_py(), np.int32)), pa.array(o), pa.array(before[k : k + EMITTED], from_pandas=True)], ["part", "o", "b"])

    v = x.mapInArrow(pack, "part int, o binary").groupBy("part").applyInArrow(neighbours, "part int, o double, b double")
    by = v.groupBy("part").agg(F.count_if(value(F.col("o")) < value(F.col("b"))).alias("drops"), F.min("o").alias("lo"), F.max("o").alias("hi"))
    last = F.lag("hi").over(Window.orderBy("part"))  # of at most as many rows as there are parts
    drops = by.withColumn("last", last).agg(F.coalesce(F.sum(F.col("drops") + F.coalesce((value(F.col("lo")) < value(F.col("last"))).cast("long"), F.lit(0))), F.lit(0)).alias("drops"))
    return one.drop("cuts").crossJoin(drops)


def entropy(counts: DataFrame, group: str, count: str) -> DataFrame:
    """group, classes, entropy, share of the largest entropy possible (0 for one class)."""
    total = counts.groupBy(group).agg(F.sum(count).alias("t"), F.count(F.lit(1)).alias("classes"))
    p = F.col(count) / F.col("t")
    h = counts.join(total, group).where(F.col(count) > 0).groupBy(group, "classes").agg(F.sum(-p * F.log2(p)).alias("entropy"))
    return h.withColumn("normalized", F.when(F.col("classes") > 1, F.col("entropy") / F.log2(F.col("classes").cast("double"))).otherwise(0.0))


def covariance(vecs: DataFrame, column: str) -> tuple[int, np.ndarray, np.ndarray]:
    """n, mean and covariance (n - 1) of vectors: partitions sum their own outer products, entries meet by place with partial sums, the driver gets one matrix of fixed size."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                m = np.stack(b[column].to_list()).astype(np.float64)
                m = np.concatenate([np.ones((len(m), 1)), m], axis=1)
                total = m.T @ m if total is None else total + m.T @ m
        if total is not None:
            yield pd.DataFrame({"width": len(total), "place": np.arange(total.size), "x": total.ravel()})

    entries = vecs.select(column).mapInPandas(sums, "width int, place int, x double").groupBy("width", "place").agg(F.sum("x").alias("x")).collect()
    if not entries:
        raise ValueError("no vectors")
    width = entries[0]["width"]
    total = np.zeros(width * width)
    for e in entries:
        total[e["place"]] = e["x"]
    total = total.reshape(width, width)
    n, s = total[0, 0], total[0, 1:]
    return int(n), s / n, (total[1:, 1:] - np.outer(s, s) / n) / max(1, n - 1)


def principal_components(vecs: DataFrame, column: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, k components (columns; the largest entry of each is positive) and shares of variance of all."""
    _, mean, cov = covariance(vecs, column)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), range(vectors.shape[1])])
    return mean, (vectors * signs)[:, :k], values / max(values.sum(), 1e-300)


def _sums(vecs: DataFrame, column: str, of: object) -> np.ndarray:
    """The sum over all batches of a matrix that ``of`` makes of each; partitions sum their own, entries meet by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                one = of(b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(total.size, total.shape[1])), pa.array(np.arange(total.size)), pa.array(total.ravel())], ["wide", "place", "x"])

    got = vecs.select(column).mapInArrow(run, "wide long, place long, x double").groupBy("wide", "place").agg(F.sum("x").alias("x")).toArrow()
    if not len(got):
        raise ValueError("no vectors")
    out = np.zeros(len(got))
    out[got["place"].to_numpy()] = got["x"].to_numpy()
    return out.reshape(-1, got["wide"][0].as_py())


def leading_components(vecs: DataFrame, column: str, k: int, extra: int = 10, blocks: int = 6, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, the k leading components (columns; the largest entry of each is positive) and their shares of variance.

    A randomised range finder: from random directions on, each pass multiplies the newest block of directions by the
    covariance, as sums of d x (k + extra) entries, and what is new of it becomes the next block; no matrix of d x d is
    made anywhere. At the end a tall-skinny QR of the rows' coordinates in all directions, partition by partition and
    then group by group, leaves a small triangle whose singular values are those of the rows.
    """
    usable = vecs.where(F.col(column).isNotNull()).select(F.col(column).cast("array<double>").alias("v"))
    first = _sums(usable, "v", lambda x: np.concatenate([[len(x), (x * x).sum()], x.sum(axis=0)])[None])[0]
    n, d, mean = first[0], len(first) - 2, first[2:] / first[0]
    total = first[1] - n * (mean @ mean)
    rng = np.random.default_rng(seed)
    basis = np.linalg.qr(rng.normal(size=(d, min(d, k + extra))))[0]
    last = basis
    for _ in range(blocks - 1):
        if basis.shape[1] >= d:
            break
        g = _sums(usable, "v", lambda x, v=last: (x - mean).T @ ((x - mean) @ v))
        for _ in range(2):
            g = g - basis @ (basis.T @ g)
        new, r = np.linalg.qr(g)
        keep = np.abs(np.diag(r)) > 1e-10 * max(total, 1e-300)
        last = new[:, keep][:, : d - basis.shape[1]]
        if not last.shape[1]:
            break
        basis = np.hstack([basis, last])
    m = basis.shape[1]

    def triangle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, m))
        for b in batches:
            if b.num_rows:
                y = (b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) - mean) @ basis
                r = np.linalg.qr(np.vstack([r, y]), mode="r")
        if len(r):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, r.size + 1, m), pa.int32()), pa.array(r.ravel()))
            yield pa.RecordBatch.from_arrays([lists], ["r"])

    def joined(t: pa.Table) -> pa.Table:
        r = np.linalg.qr(t["r"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, m), mode="r")
        return pa.table({"r": pa.ListArray.from_arrays(pa.array(np.arange(0, r.size + 1, m), pa.int32()), pa.array(r.ravel()))})

    made = usable.mapInArrow(triangle, "r array<double>").groupBy((F.spark_partition_id() % 16).alias("g")).applyInArrow(joined, "r array<double>").toArrow()
    _, sizes, right = np.linalg.svd(np.linalg.qr(made["r"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, m), mode="r"), full_matrices=False)
    components = (basis @ right.T)[:, :k]
    signs = np.sign(components[np.abs(components).argmax(axis=0), range(components.shape[1])])
    return mean, components * signs, sizes[:k] ** 2 / max(total, 1e-300)


def dims_for_variance(shares: np.ndarray, part: float = 0.95) -> int:
    return int((np.cumsum(shares) < part).sum()) + 1


def project(vecs: DataFrame, column: str, mean: np.ndarray, components: np.ndarray, name: str = "coords") -> DataFrame:
    """Adds the coordinates on the components, as JVM expressions."""
    centred = F.zip_with(column, F.array(*[F.lit(float(m)) for m in mean]), lambda x, m: x - m)
    axes = [F.aggregate(F.zip_with(centred, F.array(*[F.lit(float(c)) for c in components[:, j]]), lambda x, c: x * c), F.lit(0.0), lambda s, x: s + x) for j in range(components.shape[1])]
    return vecs.withColumn(name, F.array(*axes))


def density(points: DataFrame, x: str, y: str, side: int = 50) -> DataFrame:
    """gx, gy, density: Gaussian kernel density (Scott's rule) on an even grid over the range of the points. Each task sums its points over the grid, so only grids are exchanged."""
    s = points.agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"), F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy"), F.covar_samp(x, y).alias("vxy")).first()
    h = (s["n"] ** (-1 / 6)) ** 2
    vx, vy, vxy = s["vx"] * h, s["vy"] * h, s["vxy"] * h
    det = vx * vy - vxy * vxy
    gx, gy = np.linspace(s["x0"], s["x1"], side), np.linspace(s["y0"], s["y1"], side)
    scale = 1 / (s["n"] * 2 * math.pi * math.sqrt(det))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((side, side))
        for b in batches:
            for at in range(0, len(b), 1024):
                dx, dy = gx[:, None] - b["x"].to_numpy()[at : at + 1024], gy[:, None] - b["y"].to_numpy()[at : at + 1024]
                q = (dx * dx * vy)[:, None, :] - 2 * vxy * dx[:, None, :] * dy[None] + (dy * dy * vx)[None]
                total += np.exp(-q / (2 * det)).sum(axis=2)
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"gx": i.ravel(), "gy": j.ravel(), "x": total.ravel()})

    parts = points.select(F.col(x).alias("x"), F.col(y).alias("y")).mapInPandas(sums, "gx int, gy int, x double")
    return parts.groupBy("gx", "gy").agg((F.sum("x") * scale).alias("density"))


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """f, df_between, df_within of one-way analysis of variance, from the groups' sums."""
    by = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    s = by.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.sum(F.col("n") * F.col("v")).alias("within"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("squares"))
    between = F.col("squares") - F.col("n") * F.col("mean") * F.col("mean")
    df1, df2 = F.col("k") - 1, F.col("n") - F.col("k")
    return s.select(F.when((df1 > 0) & (df2 > 0) & (F.col("within") > 0), between / df1 / (F.col("within") / df2)).alias("f"), df1.alias("df_between"), df2.alias("df_within"))


def ab_test(df: DataFrame, arm: str, flag: str) -> DataFrame:
    """a, b, rate_a, rate_b, z of each pair of arms: difference of rates over its pooled error."""
    by = df.groupBy(F.col(arm).alias("arm")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(flag).cast("int")).alias("p"))
    a, b = by.alias("a"), by.alias("b")
    x = a.join(b, F.col("a.arm") < F.col("b.arm")).select(F.col("a.arm").alias("a"), F.col("b.arm").alias("b"), F.col("a.p").alias("rate_a"), F.col("b.p").alias("rate_b"), F.col("a.n").alias("na"), F.col("b.n").alias("nb"))
    pooled = (F.col("rate_a") * F.col("na") + F.col("rate_b") * F.col("nb")) / (F.col("na") + F.col("nb"))
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("na") + 1 / F.col("nb")))
    return x.select("a", "b", "rate_a", "rate_b", F.when(error > 0, (F.col("rate_b") - F.col("rate_a")) / error).alias("z"))


def logistic_fit(df: DataFrame, features: list[str], flag: str) -> dict[str, float]:
    """log_likelihood, aic and n of an unpenalised logistic fit; the likelihood is summed by the cluster."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    x = VectorAssembler(inputCols=features, outputCol="x").transform(df.withColumn("y", F.col(flag).cast("double")).dropna(subset=[*features, "y"])).select("x", "y")
    model = LogisticRegression(featuresCol="x", labelCol="y", regParam=0.0, maxIter=200, tol=1e-9).fit(x)
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), vector_to_array("probability")[1]))
    one = model.transform(x).agg(F.sum(F.col("y") * F.ln(p) + (1 - F.col("y")) * F.ln(1 - p)).alias("l"), F.count(F.lit(1)).alias("n")).first()
    return {"log_likelihood": one["l"], "aic": 2 * (len(features) + 1) - 2 * one["l"], "n": one["n"]}


def compare_models(df: DataFrame, features: list[str], product: str, flag: str) -> dict[str, float]:
    """AIC of separate features and of their one product, and the likelihood ratio with its probability."""
    a, m = logistic_fit(df, features, flag), logistic_fit(df, [product], flag)
    ratio = 2 * (a["log_likelihood"] - m["log_likelihood"])
    return {"additive_aic": a["aic"], "multiplicative_aic": m["aic"], "likelihood_ratio": ratio, "p": chi_square_p(max(0.0, ratio), len(features) - 1)}


def size_for_effect(effect: float = 0.3, alpha: float = 0.05, power: float = 0.8, rate: float = 1.0) -> int:
    """Rows of each of two samples with which a two-sided z test finds the effect, over the expected rate."""
    z = NormalDist().inv_cdf
    return math.ceil(2 * ((z(1 - alpha / 2) + z(power)) / effect) ** 2 / rate)
