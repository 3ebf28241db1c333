"""Hard-negative mining with a pivot table.

Vectors are made integer, and each gets one more component so that all have the same length: then a larger inner
product with an anchor is a smaller Euclidean distance to it. A table keeps every row's distances to a few pivots. By
the triangle inequality the distance between an anchor and a row lies between the largest difference and the least sum
of their distances to the pivots, which brackets the score. Rows whose bracket cannot matter are dropped; the products
of the rest are made and decide.

Anchors are a stated query set and meet all rows in blocks: a cell holds a block of anchors and a block of rows, and
lists a bounded number of rows for each anchor. A first pass finds the positives, a second one the rows of other labels
whose scores lie in the ranges that the positives set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import arrow_map, materialize

POSITIVES, NEGATIVES = 5, 5
#: Least and most share of the positive's score, in hundredths.
LEAST, MOST = 80, 100
#: Pivots, and rows of the sample they are chosen from, farthest first.
PIVOTS, PIVOT_SAMPLE = 16, 512
#: Anchors of a cell, bytes of vectors of a cell's rows at most, and rows of a cell at least where there are enough.
ANCHORS, CELL_BYTES, CELL_ROWS = 2048, 16 << 20, 2048
#: Anchors and rows of a cell that meet at once.
TILE = 256
#: Whole numbers up to this one are exact as doubles, and so are sums of products below it in any order.
EXACT = 1 << 53
#: Scores are decimals on the way, as sums of products of large components pass 64 bits; beyond 38 digits all are one.
SCORE, MOST_SCORE = "decimal(38,0)", 10**38 - 1


def is_anchor() -> Column:
    return F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False))


def relabelled() -> Column:
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def usable(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """row_no, vec_id, label, q (array of doubles that are whole numbers) of rows with a label and a whole vector of finite components."""
    x = F.col("embedding")
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c).cast("double") * scale != float("inf")))
    rows = vectors.where(F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))
    # A float times a power of two is exact; floor() of a double would give a long, which large components overflow.
    whole = lambda c: (c.cast("double") * scale) - F.call_function("pmod", c.cast("double") * scale, F.lit(1.0))
    return rows.select(F.monotonically_increasing_id().alias("row_no"), "vec_id", F.col("label").cast("long").alias("label"), F.transform(x, whole).alias("q"))


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.list_value_length(flat).to_numpy(zero_copy_only=False)
    values = flat.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dims).all():
        return values.reshape(-1, dims)
    out = np.zeros((len(sizes), dims))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def farthest_first(x: np.ndarray, n: int) -> np.ndarray:
    """At most n rows: the longest, then each time the row farthest from those chosen; equal rows once."""
    chosen = [int(np.argmax((x * x).sum(axis=1)))]
    gap = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < n and gap.max() > 0:
        chosen.append(int(np.argmax(gap)))
        gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


class Table:
    """The rows with their distances to pivots (row_no, vec_id, label, q, far), written to the shared folder."""

    def __init__(self, vectors: DataFrame, scale: int = 256, pivots: int = PIVOTS) -> None:
        rows = usable(vectors, scale)
        square = F.aggregate("q", F.lit(0.0), lambda s, x: s + x * x)
        own = rows.agg(F.count(F.lit(1)), F.max(F.size("q")), F.max(square)).first()
        self.n, self.dims, self.longest = own[0], own[1] or 0, own[2] or 0.0
        if not self.n:
            return
        some = rows.select("q", F.xxhash64("q").alias("h")).orderBy("h").limit(PIVOT_SAMPLE).select("q").toArrow()
        lift, dims, longest = self._lift, self.dims, self.longest
        self.pivots = at = farthest_first(lift(matrix(some["q"], dims), longest), pivots)

        def run(batch: pa.RecordBatch) -> pa.Table:
            x = lift(matrix(batch.column(3), dims), longest)
            far = np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in at], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, far.size + 1, len(at)), pa.int32()), pa.array(far.ravel()))
            return pa.table({**{c: batch.column(c) for c in ("row_no", "vec_id", "label", "q")}, "far": lists})

        kind = rows.schema["vec_id"].dataType.simpleString()
        # The third argument names a column by whose bytes batches are cut; ids are short, so that batches have a bounded number of rows.
        self.rows = materialize(arrow_map(rows.select("row_no", "vec_id", "label", "q", F.lit("").alias("_")), run, f"row_no long, vec_id {kind}, label long, q array<double>, far array<double>", 4), "pivot-table")
        self.kind = kind

    @staticmethod
    def _lift(x: np.ndarray, longest: float) -> np.ndarray:
        """Rows with the component that makes all as long as the longest."""
        return np.hstack([x, np.sqrt(np.maximum(longest - (x * x).sum(axis=1), 0))[:, None]])

    def cells(self, anchors: DataFrame, extra: list[str]) -> DataFrame:
        """x, y, side (0 an anchor, 1 a row) and the columns of both, for each cell of anchors (``extra`` columns are theirs) and rows."""
        spark = self.rows.sparkSession
        size = max(1, min(1 << 16, CELL_BYTES // (8 * (self.dims + PIVOTS) + 64)))
        ny = max(-(-self.n // size), min(2 * spark.sparkContext.defaultParallelism, self.n // CELL_ROWS), 1)
        nx = max(1, -(-anchors.count() // ANCHORS))
        part = lambda n: F.pmod(F.xxhash64("row_no"), F.lit(n)).cast("int")
        all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        none = [F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in extra]
        columns = ["row_no", "vec_id", "label", "q", "far"]
        own = anchors.select(part(nx).alias("x"), all_of(ny).alias("y"), F.lit(0).alias("side"), *columns, *extra)
        # A row's vector goes to each block of anchors, an anchor's to each block of rows.
        rows = self.rows.select(all_of(nx).alias("x"), part(ny).alias("y"), F.lit(1).alias("side"), *columns, *none)
        return own.unionByName(rows)


class Cell:
    """The anchors and rows of a cell. Rows are in order of id (null ids last) and number, so that a place breaks ties."""

    def __init__(self, t: pa.Table, dims: int, longest: float, pivots: np.ndarray) -> None:
        # A null id would sort first or last by the kernel's own choice; here it is last.
        self.anchors = t.filter(pc.equal(t["side"], 0))
        rows = t.filter(pc.equal(t["side"], 1))
        self.rows = rows.take(pc.sort_indices(rows, [("vec_id", "ascending"), ("row_no", "ascending")], null_placement="at_end"))
        self.a, self.r = matrix(self.anchors["q"], dims), matrix(self.rows["q"], dims)
        self.fr = matrix(self.rows["far"], len(pivots))
        # As a query, an anchor has 0 for the further component, so its distances are not those of its row.
        square = (self.a**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :]
        self.fa = np.sqrt(np.maximum(square - 2 * self.a @ pivots[:, :dims].T, 0))
        self.label_a, self.label_r = self.anchors["label"].to_numpy(), self.rows["label"].to_numpy()
        self.no_a, self.no_r = self.anchors["row_no"].to_numpy(), self.rows["row_no"].to_numpy()
        self.longest = longest
        big = max([float(np.abs(x).max()) for x in (self.a, self.r) if x.size], default=0.0)
        self.exact = big * big * max(1, dims) < EXACT

    def bracket(self, at: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and most score of anchors ``at`` with rows ``to``, from the distances to pivots, with room for rounding."""
        near = np.zeros((len(at), len(to)))
        far = np.full((len(at), len(to)), np.inf)
        for p in range(self.fa.shape[1]):
            a, r = self.fa[at, p][:, None], self.fr[to, p][None, :]
            np.maximum(near, np.abs(a - r), out=near)
            np.minimum(far, a + r, out=far)
        # |a - x|^2 = |a|^2 + longest - 2 a.x, as an anchor's own further component is 0.
        base = (self.a[at] ** 2).sum(axis=1)[:, None] + self.longest
        room = 1e-5 * (base + self.longest) + 1
        most = float(MOST_SCORE)
        return np.clip((base - far * far - room) / 2, -most, most), np.clip((base - near * near + room) / 2, -most, most)

    def products(self, a: int, to: np.ndarray) -> np.ndarray:
        """Scores of an anchor with rows; whole numbers, of Python's kind where doubles would round."""
        if self.exact:
            return (self.r[to] @ self.a[a]).astype(np.int64)
        own = [int(x) for x in self.a[a]]
        return np.array([max(-MOST_SCORE, min(MOST_SCORE, sum(int(x) * y for x, y in zip(self.r[i], own, strict=True)))) for i in to.tolist()], object)


def first(scores: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Places among ``scores`` of the k highest, highest first, ties by ``at``, which rises; all ties of the last are weighed."""
    order = np.arange(len(scores))
    if len(scores) > 4 * k and scores.dtype != object:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        order = np.flatnonzero(scores >= least)
    if scores.dtype == object:
        return np.array(sorted(order.tolist(), key=lambda i: (-scores[i], at[i]))[:k], np.int64)
    return order[np.lexsort((at[order], -scores[order]))][:k]


def _limited(found: DataFrame, by: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("other_id"), "other_no")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def positives(table: Table, anchors: DataFrame, k: int) -> DataFrame:
    """anchor_no, other_id, other_no, score: of each anchor its first k other rows of the same label."""
    dims, longest, pivots = table.dims, table.longest, table.pivots

    def run(key: tuple, t: pa.Table) -> pa.Table:
        c = Cell(t, dims, longest, pivots)
        out: list[tuple[int, int, int]] = []
        for label in np.unique(c.label_a):
            to = np.flatnonzero(c.label_r == label)
            own = np.flatnonzero(c.label_a == label)
            for i in range(0, len(own), TILE):
                at = own[i : i + TILE]
                lo, hi = c.bracket(at, to)
                for a, low, high in zip(at.tolist(), lo, hi, strict=True):
                    others = c.no_r[to] != c.no_a[a]
                    # k rows score at least this much, so a row that cannot reach it is not among the first k.
                    sure = low[others]
                    floor = np.partition(sure, len(sure) - k)[len(sure) - k] if len(sure) > k else -np.inf
                    left = to[others & ~(high < floor)]  # what is too large for doubles to compare stays
                    s = c.products(a, left)
                    out += [(a, left[j], s[j]) for j in first(s, left, k).tolist()]
        return listed(c, out)

    return _limited(table.cells(anchors, []).groupBy("x", "y").applyInArrow(run, _found(table)), ["anchor_no"], k)


def _found(table: Table) -> str:
    return f"anchor_no long, other_id {table.kind}, other_no long, score {SCORE}"


def listed(c: Cell, found: list[tuple[int, int, int]]) -> pa.Table:
    a, r, s = ([x[i] for x in found] for i in range(3))
    of = c.rows.take(pa.array(r, pa.int64()))
    return pa.table({"anchor_no": pa.array(c.no_a[a] if a else [], pa.int64()), "other_id": of["vec_id"], "other_no": of["row_no"], "score": pa.array([int(x) for x in s], pa.decimal128(38, 0))})


def negatives(table: Table, anchors: DataFrame, k: int, least: int, most: int) -> DataFrame:
    """anchor_no, bound, other_id, other_no, score: for each anchor and each of its ``bounds`` (distinct scores of positives), the first k rows of other labels with least * bound <= 100 * score <= most * bound."""
    dims, longest, pivots = table.dims, table.longest, table.pivots

    def run(key: tuple, t: pa.Table) -> pa.Table:
        c = Cell(t, dims, longest, pivots)
        out: list[tuple[int, int, int]] = []
        bound: list[int] = []
        bounds = [[int(x) for x in b] for b in c.anchors["bounds"].to_pylist()]
        every = np.arange(len(c.no_r))
        for i in range(0, len(c.no_a), TILE):
            at = np.arange(i, min(i + TILE, len(c.no_a)))
            for j in range(0, len(every), 16 * TILE):
                to = every[j : j + 16 * TILE]
                lo, hi = c.bracket(at, to)
                for a, low, high in zip(at.tolist(), lo, hi, strict=True):
                    # A range is empty where the bound is below 0.
                    ranges = [b for b in bounds[a] if least * b <= most * b]
                    if not ranges:
                        continue
                    may = ~(high < least * min(ranges) / 100) & ~(low > most * max(ranges) / 100) & (c.label_r[to] != c.label_a[a])
                    left = to[may]
                    s = c.products(a, left)
                    for b in ranges:
                        inside = np.flatnonzero((100 * s >= least * b) & (100 * s <= most * b))
                        for x in inside[first(s[inside], left[inside], k)].tolist():
                            out.append((a, left[x], s[x]))
                            bound.append(b)
        return listed(c, out).append_column("bound", pa.array(bound, pa.decimal128(38, 0)))

    met = table.cells(anchors, ["bounds"]).groupBy("x", "y").applyInArrow(run, f"{_found(table)}, bound {SCORE}")
    return _limited(met, ["anchor_no", "bound"], k)


def mine(vectors: DataFrame, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, pivots: int = PIVOTS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of vectors (vec_id, embedding, label).

    Rows with a null label, a null vector, or a null or non-finite component take no part. Vectors may have different
    lengths, the shorter ones end in zeros; an empty one scores 0 with all. A row with a null id is no anchor, and the
    last among ties. Rows that repeat an id are rows of their own, equal ones in ties in any order, and an anchor's own
    row is no positive of its. Scores that pass 64 bits are compared as they are, up to 38 digits, and given as null. An empty table gives
    an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["vec_id"].dataType.simpleString()
    table = Table(vectors.withColumn("label", relabelled()), pivots=pivots)
    if not table.n:
        return spark.createDataFrame([], f"anchor_id {kind}, positive_id {kind}, rank int, negative_id {kind}, positive_score long, negative_score long")
    anchors = table.rows.where(is_anchor())
    good = materialize(positives(table, anchors, n_positives).select("anchor_no", F.col("other_id").alias("positive_id"), F.col("score").alias("bound")), "positives")
    bounds = good.groupBy("anchor_no").agg(F.sort_array(F.collect_set("bound")).alias("bounds"))
    asked = materialize(anchors.join(bounds.withColumnRenamed("anchor_no", "row_no"), "row_no"), "asked")
    bad = negatives(table, asked, n_negatives, least, most)
    long = lambda c: F.expr(f"try_cast({c} AS bigint)")
    return good.join(bad, ["anchor_no", "bound"]).join(asked.select(F.col("row_no").alias("anchor_no"), F.col("vec_id").alias("anchor_id")), "anchor_no").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), long("bound").alias("positive_score"), long("score").alias("negative_score"))


ORACLE_SQL = f"""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= {POSITIVES})
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INTEGER AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LEAST} * positive_score <= 100 * score AND 100 * score <= {MOST} * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) <= {NEGATIVES}
"""
