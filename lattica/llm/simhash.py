"""SimHash near-dedup with multi-index hashing.

A fingerprint of 64 bits is two segments of 32. Of two fingerprints that differ in at most three bits, one segment
differs in at most one: every fingerprint is filed under its segments, and looks up each segment's Hamming ball of
radius one. Of two values one bit apart just one has that bit clear, so only clear bits are set on the way. Matches
are verified by their whole distance. Equal fingerprints are one entry, whatever the number of documents, and the
answer goes back to each run of rows by itself. A filed value with more than ``MEET`` entries is filed by the halves of
the other segment as well (one of which differs in at most one bit), so that no entry meets a whole large group; one
plan does both, and the links are the same for any ``MEET``. Links make components by rounds of smallest-neighbour
stars over tables in the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import arrow_map, by_run, dealt, drop_scratch, materialize, numbered, of_numbers, utf8
from lattica.llm.words import LOWER

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Entries that meet under one segment value alone.
MEET = 512


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    """SimHash of the k-word shingles of a lower-cased text, repeats included; 0 without words."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= k:
        cut = [joined]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(sizes) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        cut = [joined[a:b] for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(cut), 1 << 16):
        h = np.array([digest(s, SEED) for s in cut[at : at + (1 << 16)]], np.uint64)
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(cut), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, number: Column, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """doc_id, row_no, run, fp (the 64 bits as a long), one row per input row. Null text has no words."""

    def run(batch: pa.RecordBatch) -> pa.Table:
        fps = np.array([fingerprint(t, k) for t in utf8(batch.column(1))], np.uint64).view(np.int64)
        return pa.table({"doc_id": batch.column(0), "row_no": batch.column(2), "run": batch.column(3), "fp": pa.array(fps)})

    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), number.alias("row_no"), F.spark_partition_id().alias("run"))
    return arrow_map(read, run, f"doc_id {kind}, row_no long, run int, fp long")


def _bits(x: Column, low: int, n: int) -> Column:
    return F.call_function("shiftrightunsigned", x, F.lit(low)).bitwiseAND(F.lit((1 << n) - 1).cast("long"))


def _ball(x: Column, n: int) -> Column:
    """The value and all values with one clear bit set."""
    one = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
    return F.array_distinct(F.concat(F.array(x), F.transform(one, lambda b: x.bitwiseOR(b))))


def _full_ball(x: Column, n: int) -> Column:
    one = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
    return F.concat(F.array(x), F.transform(one, lambda b: x.bitwiseXOR(b)))


def links(fps: DataFrame) -> DataFrame:
    """a < b: all pairs of distinct fingerprints (column fp, each once) that differ in at most three bits.

    A fingerprint has at most 43,744 others within three bits, so pairs grow with fingerprints, not with their square.
    """
    segment = lambda s: F.struct(F.lit(s).alias("seg"), _bits(F.col("fp"), 32 * s, 32).alias("key"))
    probe = lambda s: F.transform(_ball(_bits(F.col("fp"), 32 * s, 32), 32), lambda v: F.struct(F.lit(s).alias("seg"), v.alias("key")))
    filed = fps.select("fp", F.inline(F.array(segment(0), segment(1))))
    asked = fps.select("fp", F.inline(F.concat(probe(0), probe(1))))
    hot = filed.groupBy("seg", "key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > MEET).select("seg", "key", F.lit(True).alias("hot"))
    hot = materialize(hot, "hot")
    near = (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= RADIUS) & (F.col("fp") != F.col("other"))

    def met(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        return left.join(right.withColumnRenamed("fp", "other"), keys).where(near).select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"))

    mark = lambda x: x.join(hot, ["seg", "key"], "left")
    filed, asked = mark(filed), mark(asked)
    cold = met(asked.where("hot IS NULL").drop("hot"), filed.where("hot IS NULL").drop("hot"), ["seg", "key"])
    rest = F.when(F.col("seg") == 0, _bits(F.col("fp"), 32, 32)).otherwise(_bits(F.col("fp"), 0, 32))
    quarter = lambda q: _bits(rest, 16 * q, 16)
    finer = filed.where("hot").select("seg", "key", "fp", F.inline(F.array(*[F.struct(F.lit(q).alias("q"), quarter(q).alias("sub")) for q in (0, 1)])))
    tagged = lambda q: F.transform(_full_ball(quarter(q), 16), lambda v: F.struct(F.lit(q).alias("q"), v.alias("sub")))
    finer_asked = asked.where("hot").select("seg", "key", "fp", F.inline(F.concat(tagged(0), tagged(1))))
    return cold.unionByName(met(finer_asked, finer, ["seg", "key", "q", "sub"])).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each connected component of edges (a, b). Nodes without edges don't appear.

    Each round points every node at the smallest neighbour's label and then at that label's own label. Labels only
    fall, and a round that changes none ends it. All tables stay distributed; a hub is only ever an aggregation key.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("heard"))
        told = labels.join(heard, "node").select("node", F.col("root").alias("was"), F.least("root", "heard").alias("root"))
        # A label hears of the smaller labels its members have met (hooking), then labels are followed once (jumping).
        # Labels of large components are hot keys, so both joins go by runs.
        hook = told.groupBy("was").agg(F.min("root").alias("to"))
        hooked = by_run(dealt(told, "node"), hook, ["was"]).select("node", "was", "run", F.least("root", "to").alias("root"))
        jump = hooked.select(F.col("node").alias("root"), F.col("root").alias("far"))
        after = by_run(hooked, jump, ["root"], "left").select("node", "was", F.least("root", F.coalesce("far", "root")).alias("root"))
        after = materialize(after, "labels")
        drop_scratch(labels)
        labels = after.select("node", "root")
        if after.where("root != was").isEmpty():
            drop_scratch(both)
            return labels


def _grouped(docs: DataFrame, id_col: str, text_col: str, k: int, number: Column) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of rows; and of each fingerprint its component's first row (null ids last)."""
    rows = materialize(fingerprints(docs, number, id_col, text_col, k), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_no")).alias("least")
    nodes = materialize(rows.groupBy("fp").agg(first), "nodes")
    roots = components(links(nodes.select("fp")))
    grouped = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    firsts = grouped.groupBy("root").agg(F.min("least").alias("first"))
    return rows, by_run(dealt(grouped, "fp"), firsts, ["root"]).select("fp", "first")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint, component_id: one row per input row; component_id is the smallest doc_id that links reach.

    Null, empty and blank texts have fingerprint 0, linked like any other. Rows that repeat an id are rows of their
    own. A null id is never the smallest. A very long text is one row like others. An empty table gives an empty
    result; other columns are ignored.
    """
    rows, of = _grouped(docs, id_col, text_col, k, F.monotonically_increasing_id())
    return by_run(rows, of, ["fp"]).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, F.lit("0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """One row of each component, with all columns: that of the smallest id (null ids last, of repeated ids one row).

    Ids may be of any type that has an order; columns may have any names. An empty table gives an empty result.
    """
    rows, number = numbered(docs)
    prints, of = _grouped(rows, id_col, text_col, k, F.col(number))
    chosen = materialize(of.select("first.row_no").distinct(), "stay")
    drop_scratch(prints)
    return of_numbers(rows, number, chosen)
