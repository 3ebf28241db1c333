"""Similarity joins and nearest neighbours over vectors.

``similar_pairs`` deals rows into blocks and sends each block to the cells of a triangle of block pairs, so every pair
meets once and a task holds two blocks. Within a cell a matrix product finds the pairs. Blocks are range parts by the
rows' angle to a pivot, and by a hash of their ids where angles are equal, so that no block grows beyond its size.
Where the angles of two blocks differ by more than the threshold allows, the cell is never made, which is exact by the
triangle inequality on angles. Products are made in single precision, and those near the threshold or above are made
again in double. Ids may be of any type that has an order. ``similar_pairs_sql`` is the same join as a JVM expression.
Blocks grow with the table up to a bound, so that a row is sent to few cells, and pairs leave a cell as they are found.
Columns that pairs need of their ends travel with the vectors, so that no join has to look them up for every pair.

``nearest`` keeps at most k rows for each vector of a cell. Cells are made in rounds of growing distance between blocks;
after a round, cells are left out whose angles are so far apart that nothing in them can be among the k best any more.
``nearest_indexed`` is an inverted file: vectors are listed under the nearest of some centroids and asked for under
several, which finds most neighbours at a part of the work.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.vector import dot, norm, unit
from lattica.sources.scratch import settle

#: Rows of a block; of a larger table's block at most, in rows and in bytes of vectors; and blocks that are aimed at.
BLOCK = 4096
MOST_ROWS, MOST_BYTES, AIM = 1 << 16, 1 << 25, 10
#: Products of a cell that are made at once.
PRODUCTS = 1 << 22


def _to_pivot(u: Column) -> Column:
    """Angle to a fixed direction of mixed signs, so that sparse vectors, or such with constant entries, don't all have one."""
    signed = F.transform(u, lambda x, i: F.when(F.xxhash64(i) % 2 == 0, x).otherwise(-x))
    cosine = F.aggregate(signed, F.lit(0.0), lambda s, x: s + x) / F.sqrt(F.size(u))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def _blocks(vecs: DataFrame, block: int | None, parts: int, carry: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Unit vectors (id, u, angle, b) with their block, and the blocks (b, lo, hi, m) with their range of angles and size.

    Blocks are numbered in order of angle. Their size grows with the table if it isn't given.
    """
    usable = vecs.where(norm(F.col("v")) > 0).select("id", unit(F.col("v")).alias("u"), *carry)
    n, width = usable.agg(F.count(F.lit(1)), F.max(F.size("u"))).first()
    block = block or max(BLOCK, min(MOST_ROWS, MOST_BYTES // (8 * (width or 1)), -(-n // AIM)))
    k = max(1, -(-n // block), min(parts, n // 256))
    with_angle = usable.withColumn("angle", _to_pivot(F.col("u")))
    dealt = with_angle.repartitionByRange(k, "angle", F.xxhash64("id")) if k > 1 else with_angle
    # The part's number is written with the row, so that it stays what it was when the plan is run again.
    rows = settle(dealt.withColumn("b", F.spark_partition_id() if k > 1 else F.lit(0)), "blocks")
    return rows, rows.groupBy("b").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.count(F.lit(1)).alias("m"))


def _near(bounds: DataFrame, reach: float) -> DataFrame:
    """x <= y, gap: pairs of blocks whose angles come within ``reach`` of one another; a join by cells of the angle."""
    width = max(reach, 1e-3)
    at = lambda c: F.floor(F.col(c) / width)
    a = bounds.select(F.col("b").alias("x"), F.col("lo").alias("lo_x"), F.col("hi").alias("hi_x"), F.explode(F.sequence(at("lo") - 1, at("hi") + 1)).alias("cell"))
    b = bounds.select(F.col("b").alias("y"), F.col("lo").alias("lo_y"), F.col("hi").alias("hi_y"), F.explode(F.sequence(at("lo"), at("hi"))).alias("cell"))
    gap = F.greatest(F.lit(0.0), F.col("lo_y") - F.col("hi_x"), F.col("lo_x") - F.col("hi_y"))
    return a.join(b, "cell").where("x <= y").select("x", "y", gap.alias("gap")).where(F.col("gap") <= reach).distinct()


def _sides(rows: DataFrame, cells: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """x, y, side, id, u and what is carried: every row once for each cell of its block; side is 2 in cells of a block with itself."""
    sides = cells.select("x", "y", F.explode(F.when(F.col("x") == F.col("y"), F.array(F.lit(2))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("side"))
    sides = sides.withColumn("own", F.when(F.col("side") == 1, F.col("y")).otherwise(F.col("x")))
    return rows.join(sides, rows["b"] == sides["own"]).select("x", "y", "side", "id", "u", *carry)


def _reach(threshold: float) -> float:
    return math.acos(max(-1.0, min(1.0, threshold))) + 1e-9


def _parts(vecs: DataFrame) -> int:
    return math.isqrt(2 * vecs.sparkSession.sparkContext.defaultParallelism) + 1


def _cells(vecs: DataFrame, threshold: float, block: int | None, carry: Sequence[str] = ()) -> DataFrame:
    """x, y, side, id, u: every row once for each cell of its block."""
    rows, bounds = _blocks(vecs, block, _parts(vecs), carry)
    return _sides(rows, _near(bounds, _reach(threshold)), carry)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _met(a: np.ndarray, b: np.ndarray, threshold: float, inclusive: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of a, rows of b and cosines of all pairs that reach the threshold, a bounded number at a time."""
    single = b.astype(np.float32).T
    slack = 1e-6 + 1.2e-7 * b.shape[1]
    step = max(1, PRODUCTS // max(1, len(b)))
    for at in range(0, len(a), step):
        found = np.flatnonzero(a[at : at + step].astype(np.float32) @ single >= threshold - slack)
        for k in range(0, len(found), 1 << 14):
            i, j = np.divmod(found[k : k + (1 << 14)], len(b))
            i += at
            s = np.minimum(np.einsum("ij,ij->i", a[i], b[j]), 1.0)
            # Copies have a cosine of 1, which products of rounded units may miss.
            near = np.flatnonzero(s > 1 - 1e-12)
            s[near[(a[i[near]] == b[j[near]]).all(axis=1)]] = 1.0
            ok = s >= threshold if inclusive else s > threshold
            yield i[ok], j[ok], s[ok]


def _two_sides(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table, pa.Table, bool]:
    """The rows of a cell's two blocks, and whether they are one block."""
    t = pa.Table.from_batches(batches)
    side = t["side"].to_numpy()
    if (side == 2).any():
        return t, t, True
    return t.filter(pa.array(side == 0)), t.filter(pa.array(side == 1)), False


def similar_pairs(vecs: DataFrame, threshold: float, inclusive: bool = False, block: int | None = None, carry: Sequence[str] = (), measure: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """src < dst, sim: all pairs of (id, v) with a cosine above the threshold. Null, empty and zero vectors have no pairs.

    Columns that are named in ``carry`` come out twice: src_ and dst_ of each. ``measure`` is a symmetric function of the
    vectors of many pairs, whose result is a column of that name.
    """
    more = [*carry, "length"] if measure else list(carry)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, same = _two_sides(batches)
        if not len(a) or not len(b):
            return
        ia, ib = a["id"].to_numpy(), b["id"].to_numpy()
        both = (a if same else pa.concat_tables([a, b])).select(["id", *carry]).combine_chunks()
        shift = 0 if same else len(a)
        ma, mb = _matrix(a["u"]), _matrix(b["u"])
        sizes = [t["length"].to_numpy()[:, None] for t in (a, b)] if measure else []
        for i, j, s in _met(ma, mb, threshold, inclusive):
            x, y = ia[i], ib[j]
            ok = (x < y if same else x != y).astype(bool)
            x, y, i, j, s = x[ok], y[ok], i[ok], j[ok], s[ok]
            measured = [pa.array(measure(ma[i] * sizes[0][i], mb[j] * sizes[1][j]))] if measure else []
            j = j + shift
            turned = (x > y).astype(bool)
            src, dst = both.take(pa.array(np.where(turned, j, i))), both.take(pa.array(np.where(turned, i, j)))
            one = pa.table([src["id"], dst["id"], pa.array(s), *(side[c] for c in carry for side in (src, dst)), *measured], names=names)
            yield from one.combine_chunks().to_batches()

    names = ["src", "dst", "sim", *(f"{side}_{c}" for c in carry for side in ("src", "dst")), *(["measure"] if measure else [])]
    kind = vecs.schema["id"].dataType.simpleString()
    of = "".join(f", `{side}_{c}` {vecs.schema[c].dataType.simpleString()}" for c in carry for side in ("src", "dst")) + (", measure double" if measure else "")
    with_length = vecs.withColumn("length", norm(F.col("v"))) if measure else vecs
    return _cells(with_length, threshold, block, more).groupBy("x", "y").applyInArrow(kernel, f"src {kind}, dst {kind}, sim double{of}")


def similar_pairs_sql(vecs: DataFrame, threshold: float, inclusive: bool = False) -> DataFrame:
    """As ``similar_pairs``, as one join with a JVM condition; for small tables and for checks."""
    u = vecs.where(norm(F.col("v")) > 0).select("id", unit(F.col("v")).alias("u"))
    a, b = u.alias("a"), u.alias("b")
    sim = dot(F.col("a.u"), F.col("b.u"))
    pairs = a.join(b, F.col("a.id") < F.col("b.id")).select(F.col("a.id").alias("src"), F.col("b.id").alias("dst"), sim.alias("sim"))
    return pairs.where(F.col("sim") >= threshold if inclusive else F.col("sim") > threshold)


def _best(a: np.ndarray, b: np.ndarray, k: int, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a, their k best rows of b at or above the threshold, and the cosines; ties by place in b. ``same``: row i of both is one vector."""
    row, col, sim = [], [], []
    single, slack = b.astype(np.float32).T, 1e-6 + 1.2e-7 * b.shape[1]
    for at in range(0, len(a), 512):
        own = a[at : at + 512]
        s = own.astype(np.float32) @ single
        if same:
            s[np.arange(len(own)), np.arange(at, at + len(own))] = -2
        # What may be among the k best by double precision: all within the rounding of the k-th best by single.
        kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] > k else np.full(len(own), -1.5, np.float32)
        r, c = np.nonzero(s >= np.maximum(kth - 2 * slack, max(threshold, -1.0) - slack)[:, None])
        exact = np.einsum("ij,ij->i", own[r], b[c])
        keep = exact >= threshold
        r, c, exact = r[keep], c[keep], exact[keep]
        order = np.lexsort((c, -exact, r))
        r, c, exact = r[order], c[order], exact[order]
        first = np.arange(len(r)) - np.searchsorted(r, r) < k
        row.append(r[first] + at)
        col.append(c[first])
        sim.append(exact[first])
    return (np.concatenate(row), np.concatenate(col), np.concatenate(sim)) if row else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _best_of_cell(k: int, threshold: float):  # noqa: ANN202
    """A kernel that lists, for each row of a cell (side 0 asks 1 and 1 asks 0; 2 asks itself; 3 only asks, 4 is only asked), its k best."""

    def kernel(key: tuple, t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t["id"]))
        side = t["side"].to_numpy()
        src, dst, sim = [], [], []
        for asks, asked in ((0, 1), (1, 0), (2, 2), (3, 4)):
            a, b = (t.filter(pa.array(side == x)) for x in (asks, asked))
            if not len(a) or not len(b):
                continue
            i, j, s = _best(_matrix(a["u"]), _matrix(b["u"]), k + (asks == 3), threshold, asks == asked)
            x, y = a["id"].take(pa.array(i)), b["id"].take(pa.array(j))
            if asks == 3:  # a vector may be among those it asks
                other = pc.not_equal(x, y)
                x, y, s = x.filter(other), y.filter(other), s[other.to_numpy()]
            src.append(x)
            dst.append(y)
            sim.append(s)
        none = t["id"].slice(0, 0)
        return pa.table({"src": pa.chunked_array([c for x in src for c in x.chunks], none.type), "dst": pa.chunked_array([c for x in dst for c in x.chunks], none.type), "sim": np.concatenate([np.zeros(0), *sim])})

    return kernel


def _first(found: DataFrame, k: int) -> DataFrame:
    """Adds the rank and keeps the first k of each src; Spark limits the groups before it exchanges them."""
    w = Window.partitionBy("src").orderBy(F.desc("sim"), "dst")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Distance between the blocks of the first round's cells; each round doubles it.
FIRST_ROUND = 8


def nearest(vecs: DataFrame, k: int, threshold: float, block: int = BLOCK, first_round: int = FIRST_ROUND) -> DataFrame:
    """src, dst, sim, rank: of each vector its k nearest at or above the threshold, itself not counted; ties by id. Exact.

    No cell writes more than k rows a vector. Cells whose blocks lie near one another in angle come first; a later cell
    is made only if its angles can still beat the k-th best of some row in it.
    """
    rows, bounds = _blocks(vecs, block, _parts(vecs))
    kind = vecs.schema["id"].dataType.simpleString()
    reach = _reach(threshold)
    bounds = settle(bounds, "bounds")
    n = bounds.count()
    cells = _near(bounds, reach)
    cells = settle(cells, "cells") if n > first_round else cells
    met = lambda c: _sides(rows, c).groupBy("x", "y").applyInArrow(_best_of_cell(k, threshold), f"src {kind}, dst {kind}, sim double")
    far = first_round
    best = _first(met(cells.where(F.col("y") - F.col("x") < far)), k)
    while far < n:
        best = settle(best, "nearest")
        # How far in angle each block still looks: to the worst of its rows' k-th best, or to the threshold where rows have fewer.
        full = best.where(F.col("rank") == k).select(F.col("src").alias("id"), "sim")
        looks = rows.select("id", "b").join(full, "id").groupBy("b").agg(F.count(F.lit(1)).alias("full"), F.min("sim").alias("least"))
        least = F.when(F.col("full") == F.col("m"), F.greatest(F.lit(threshold), F.col("least"))).otherwise(threshold)
        looks = settle(bounds.join(looks, "b", "left").select("b", (F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), least))) + 1e-9).alias("look")), "looks")
        ring = cells.where((F.col("y") - F.col("x") >= far) & (F.col("y") - F.col("x") < 2 * far))
        a, b = looks.select(F.col("b").alias("x"), F.col("look").alias("look_x")), looks.select(F.col("b").alias("y"), F.col("look").alias("look_y"))
        ring = ring.join(a, "x").join(b, "y").where(F.col("gap") <= F.greatest("look_x", "look_y")).select("x", "y")
        best = _first(best.drop("rank").unionByName(met(ring)), k)
        far *= 2
    return best


#: Rows of the sample that centroids are fitted on, for each list, and lists at most.
SAMPLE_EACH, MOST_LISTS = 64, 4096


def centroids(vecs: DataFrame, lists: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids by spherical k-means on a sample of at most SAMPLE_EACH rows for each list, those of the smallest hashes."""
    usable = vecs.where(norm(F.col("v")) > 0).select("id", unit(F.col("v")).alias("u"))
    m = _matrix(usable.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_EACH * lists).select("u").toArrow()["u"])
    c = m[:lists].copy()
    for _ in range(rounds if len(m) > lists else 0):
        own = np.argmax(m @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, m)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.maximum(size, 1e-12), c)
    return c


def nearest_indexed(vecs: DataFrame, k: int, threshold: float, lists: int | None = None, probes: int | None = None, block: int = BLOCK, asked: DataFrame | None = None) -> DataFrame:
    """src, dst, sim, rank, as ``nearest``, by an inverted file of ``lists`` lists of which each vector asks ``probes``.

    Every vector is listed. Rows that are found are right; some may be missed, fewer with more probes, none where all
    lists are asked. Lists beyond a block's size are cut by hashes of ids, and so are the vectors that ask them.
    ``asked`` (id, v) has the vectors that ask, all if it is not given.
    """
    n = vecs.count()
    lists = lists or max(1, min(MOST_LISTS, math.isqrt(n)))
    probes = min(lists, probes or -(-3 * lists // 4))
    if not n:
        return nearest(vecs, k, threshold, block)
    c = centroids(vecs, lists)
    kind = vecs.schema["id"].dataType.simpleString()

    def listed(df: DataFrame, most: int, side: int) -> DataFrame:
        """side, id, u, and the lists whose centroids are nearest."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                m = _matrix(pa.chunked_array([batch.column(1)]))
                s = m @ c.T
                near = np.argpartition(-s, most - 1, axis=1)[:, :most] if most < len(c) else np.tile(np.arange(len(c)), (len(m), 1))
                at = pa.array(np.repeat(np.arange(len(m)), near.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), pa.array(np.full(near.size, side, np.int32)), batch.column(0).take(at), batch.column(1).take(at)], ["list", "side", "id", "u"])

        usable = df.where(norm(F.col("v")) > 0).select("id", unit(F.col("v")).alias("u"))
        return usable.mapInArrow(run, f"list int, side int, id {kind}, u array<double>")

    probes = min(probes, len(c))
    rows = settle(listed(vecs, 1, 4), "lists").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(1 << 16)))
    asks = settle(listed(vecs if asked is None else asked, probes, 3), "asks").withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 16)))
    cuts = lambda df, name: df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    grid = settle(cuts(rows, "nx").join(cuts(asks, "ny"), "list"), "grid")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = F.broadcast(grid)  # at most MOST_LISTS rows
    met = rows.join(own, "list").select("list", F.pmod("part", F.col("nx")).cast("int").alias("x"), each("ny").alias("y"), "side", "id", "u").unionByName(
        asks.join(own, "list").select("list", each("nx").alias("x"), F.pmod("part", F.col("ny")).cast("int").alias("y"), "side", "id", "u"))
    return _first(met.groupBy("list", "x", "y").applyInArrow(_best_of_cell(k, threshold), f"src {kind}, dst {kind}, sim double"), k)


def cross_paper_pairs(chunks: DataFrame, threshold: float, same_paper: bool = False, inclusive: bool = True) -> DataFrame:
    """src, dst, sim, from_paper, to_paper of similar chunks (id, paper, v); of different papers, or of one.

    Pairs within papers are an equal join by paper: no chunk meets those of others.
    """
    if same_paper:
        u = chunks.where(norm(F.col("v")) > 0).select("id", "paper", unit(F.col("v")).alias("u"))
        a, b = u.alias("a"), u.alias("b")
        pairs = a.join(b, (F.col("a.paper") == F.col("b.paper")) & (F.col("a.id") < F.col("b.id"))).select(
            F.col("a.id").alias("src"), F.col("b.id").alias("dst"), dot(F.col("a.u"), F.col("b.u")).alias("sim"), F.col("a.paper").alias("from_paper"), F.col("b.paper").alias("to_paper"))
        return pairs.where(F.col("sim") >= threshold if inclusive else F.col("sim") > threshold)
    pairs = similar_pairs(chunks.select("id", "v", "paper"), threshold, inclusive, carry=["paper"])
    return pairs.where("src_paper <> dst_paper").select("src", "dst", "sim", F.col("src_paper").alias("from_paper"), F.col("dst_paper").alias("to_paper"))


def _paper_cells(chunks: DataFrame, block: int | None, wanted: DataFrame | None = None) -> DataFrame:
    """x, y, side, paper, u (and, at side 3, other): blocks of whole papers, every chunk once for each cell of its block.

    ``wanted`` (paper, other) are rows of the cell in which their papers meet.
    """
    usable = chunks.where(norm(F.col("v")) > 0).select("paper", unit(F.col("v")).alias("u"))
    n, width = usable.agg(F.count(F.lit(1)), F.max(F.size("u"))).first()
    block = block or max(BLOCK, min(MOST_ROWS, MOST_BYTES // (8 * (width or 1)), -(-n // AIM)))
    k = max(1, -(-n // block), min(_parts(chunks), n // 256))
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    kind = chunks.schema["paper"].dataType.simpleString()
    rows = settle(usable.withColumn("b", of("paper")), "papers")
    cells = chunks.sparkSession.range(k).select(F.col("id").cast("int").alias("x")).select("x", F.explode(F.sequence("x", F.lit(k - 1))).alias("y"))
    met = _sides(rows.withColumn("id", F.lit(None).cast(kind)), cells, ["paper"]).select("x", "y", "side", "paper", F.col("id").alias("other"), "u")
    if wanted is not None:
        a, b = of("paper"), of("other")
        met = met.unionByName(wanted.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y"), F.lit(3).alias("side"), "paper", "other", F.lit(None).cast("array<double>").alias("u")))
    return met


def _paper_tiles(t: pa.Table, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For a cell of whole papers: papers of both sides, rows of both, and cosines of chunk pairs that reach the threshold; all pairs of two papers come together."""
    side = t["side"].to_numpy()
    same = bool((side == 2).any())
    held = [t.filter(pa.array(side == s)) for s in ((2,) if same else (0, 1))]
    if not all(map(len, held)):
        return
    held = [h.take(pc.sort_indices(h["paper"])) for h in held]
    papers = [h["paper"].to_numpy() for h in held]
    m = [_matrix(h["u"]) for h in held]
    pa_, pb, a, b = papers[0], papers[-1], m[0], m[-1]
    starts = np.flatnonzero(np.concatenate([[True], (pa_[1:] != pa_[:-1]).astype(bool)]))
    ends = np.append(starts[1:], len(pa_))
    step, at, columns = max(1, PRODUCTS // len(b)), 0, b.T.copy()
    while at < len(a):
        # A tile ends where a paper does.
        to = int(ends[min(len(ends) - 1, np.searchsorted(ends, at + step))])
        s = np.minimum(a[at:to] @ columns, 1.0)
        i, j = np.divmod(np.flatnonzero(s >= threshold), len(b))
        s = s[i, j]
        i += at
        if same:
            ok = (pa_[i] < pb[j]).astype(bool)
            i, j, s = i[ok], j[ok], s[ok]
        if len(i):
            yield pa_, pb, i, j, s
        at = to


def document_pairs(chunks: DataFrame, threshold: float, k: int = 5, block: int | None = None) -> DataFrame:
    """from_paper < to_paper, num_chunk_pairs, max, mean, top_k_mean over all chunk pairs of two papers that reach the threshold; chunks are (id, paper, v).

    Blocks hold whole papers, so all chunk pairs of two papers meet in one cell and are summed up where they are made; no
    chunk pair is ever exchanged. A paper of very many chunks makes its block as much larger.
    """
    cells = _paper_cells(chunks, block)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pa_, pb, i, j, s in _paper_tiles(pa.Table.from_batches(batches), threshold):
            ka, kb = np.unique(pa_[i], return_inverse=True), np.unique(pb[j], return_inverse=True)
            key = ka[1] * len(kb[0]) + kb[1]
            order = np.lexsort((-s, key))
            key, s = key[order], s[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            n = np.diff(np.append(first, len(key)))
            place = np.arange(len(key)) - np.repeat(first, n)
            best = np.add.reduceat(np.where(place < k, s, 0.0), first) / np.minimum(n, k)
            x, y = ka[0][key[first] // len(kb[0])], kb[0][key[first] % len(kb[0])]
            turned = (x > y).astype(bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.where(turned, y, x)), pa.array(np.where(turned, x, y)), pa.array(n), pa.array(s[first]), pa.array(np.add.reduceat(s, first) / n), pa.array(best)], ["from_paper", "to_paper", "num_chunk_pairs", "max", "mean", "top_k_mean"])

    kind = chunks.schema["paper"].dataType.simpleString()
    return cells.drop("other").groupBy("x", "y").applyInArrow(kernel, f"from_paper {kind}, to_paper {kind}, num_chunk_pairs long, max double, mean double, top_k_mean double")
