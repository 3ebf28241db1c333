"""Ranked lexical search over document-sharded CSR postings with integer impacts.

1.  One pass counts terms: the number of documents that have any, and all terms.
2.  A second pass makes shards of bounded size. A shard holds its documents in order of id and, in compressed sparse row
    form, its terms' hashes in order, where each term's postings begin, and each posting's document and impact, which is
    the integer (1000000000 * tf) div (1000 * tf + 8 * m). No exchange is needed and shards are stored, their numbers
    as bytes and a few shards to a group of the file, so that a reader holds those few and no lists of numbers.
3.  Document frequencies come from the shards' dictionaries, for the terms that the items have.
4.  Items meet every shard in blocks of bounded size, a block at a time: one dense accumulator for the shard's
    documents takes the postings term by term, and a selection that keeps ties whole names the shard's best.
5.  The best of all shards are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import arrow_map, bound_batches, by_run, drop_scratch, give_back, materialize, pieces, utf8
from lattica.llm.words import LOWER, spans, word_hashes

TOP = 10
#: Documents and bytes of text of a shard at most; a larger text is a shard of its own.
SHARD_ROWS, SHARD_BYTES = 4096, 4 << 20
#: Shards that a file's writer and reader hold at once.
STORED_TOGETHER = 4
#: Types of the numbers of a shard, which are stored as bytes.
NUMBERS = {"terms": np.int64, "begins": np.int32, "docs": np.int32, "impacts": np.int32}
#: Terms of items that are sent to all workers at once. An item with more is sent alone.
BLOCK_TERMS = 1 << 19
#: Cells of item numbers from which blocks are made.
CELLS = 1 << 16
IS_WORD = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])


def term_hashes(text: bytes) -> np.ndarray:
    """Hashes of the terms of a text, in order."""
    buf = np.frombuffer(text.translate(LOWER), np.uint8)
    return word_hashes(buf, *spans(buf, IS_WORD)).view(np.int64)


def corpus_size(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Documents with a term, and all terms with repeats."""

    def run(batch: pa.RecordBatch) -> pa.Table:
        n = np.array([len(spans(np.frombuffer(t.translate(LOWER), np.uint8), IS_WORD)[0]) for t in utf8(batch.column(0))], np.int64)
        return pa.table({"some": [int((n > 0).sum())], "terms": [int(n.sum())]})

    row = arrow_map(docs.select(F.col(text_col).alias("text")), run, "some long, terms long", 0).agg(F.sum("some"), F.sum("terms")).first()
    return row[0] or 0, row[1] or 0


def shard(ids: pa.Array, texts: list[bytes], some: int, terms: int) -> dict[str, object]:
    """One shard in CSR form; its documents are in order of id, null ids last."""
    order = pc.sort_indices(ids)
    texts = [texts[i] for i in order.to_pylist()]
    each = [term_hashes(t) for t in texts]
    lengths = [len(h) for h in each]
    # Python's integers, as 75 * n * N may pass 64 bits on the way.
    m = np.array([25 + 75 * n * some // terms if n else 0 for n in lengths], np.int64)
    doc, term = np.repeat(np.arange(len(texts)), lengths), np.concatenate([np.zeros(0, np.int64), *each])
    by = np.lexsort((doc, term))
    doc, term = doc[by], term[by]
    new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])])) if len(by) else np.zeros(0, np.int64)
    tf = np.diff(np.append(new, len(by)))
    doc, term = doc[new], term[new]
    first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(new) else np.zeros(0, np.int64)
    impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
    return {"ids": ids.take(order), "terms": term[first], "begins": np.append(first, len(new)).astype(np.int32), "docs": doc.astype(np.int32), "impacts": impact.astype(np.int32)}


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_rows: int = SHARD_ROWS, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, int]:
    """The stored shards (ids, terms, begins, docs, impacts), and the number of documents with a term."""
    some, terms = corpus_size(docs, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        texts: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            s = shard(pa.concat_arrays(ids), texts, some, terms)
            held_ids = pa.ListArray.from_arrays(pa.array([0, len(s["ids"])], pa.int32()), s["ids"])
            return pa.RecordBatch.from_arrays([held_ids, *(pa.array([s[c].tobytes()], pa.binary()) for c in NUMBERS)], ["ids", *NUMBERS])

        for batch in batches:
            for piece in pieces(batch):
                own = utf8(piece.column(1))
                size = sum(map(len, own))
                if texts and (len(texts) + len(own) > shard_rows or held + size > shard_bytes):
                    yield flush()
                    ids, texts, held = [], [], 0
                ids.append(piece.column(0))
                texts += own
                held += size
        if texts:
            yield flush()
        ids, texts = [], []
        give_back()

    made = read.mapInArrow(run, f"ids array<{kind}>, " + ", ".join(f"{c} binary" for c in NUMBERS))
    return materialize(made, "shards", {"parquet.block.row.count.limit": str(STORED_TOGETHER)}), some


def numbers(batch: pa.RecordBatch, column: str, row: int) -> np.ndarray:
    """The numbers of one shard that are stored in a column, without a copy."""
    return np.frombuffer(batch.column(column)[row].as_buffer(), NUMBERS[column])


def frequencies(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """term, df of the wanted terms (distinct), from the dictionaries of all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array(numbers(batch, "terms", row)), pa.array(np.diff(numbers(batch, "begins", row)).astype(np.int64))], ["term", "n"])

    listed = index.select("terms", "begins").mapInArrow(run, "term long, n long")
    return listed.join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))


def item_terms(items: DataFrame) -> DataFrame:
    """item_no, run, term, times: the distinct terms of each item (item_no, text)."""

    def run(batch: pa.RecordBatch) -> pa.Table:
        each = [np.unique(term_hashes(t), return_counts=True) for t in utf8(batch.column(1))]
        of = batch.column(0).take(pa.array(np.repeat(np.arange(len(each)), [len(t) for t, _ in each]), pa.int64()))
        runs = batch.column(2).take(pa.array(np.repeat(np.arange(len(each)), [len(t) for t, _ in each]), pa.int64()))
        return pa.table({"item_no": of, "run": runs, "term": pa.array(np.concatenate([np.zeros(0, np.int64), *(t for t, _ in each)])), "times": pa.array(np.concatenate([np.zeros(0, np.int64), *(n for _, n in each)]))})

    return arrow_map(items.select("item_no", "text", F.spark_partition_id().alias("run")), run, "item_no long, run int, term long, times long")


def weight(df: Column, some: int) -> Column:
    """floor(1000 * ln((2N + 2) / (2df + 1))), in doubles."""
    return F.floor(1000 * F.log(F.lit(float(2 * some + 2)) / (2 * df + 1).cast("double")))


def select(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0, highest first, equal scores by place; all of the last score's ties are weighed."""
    at = np.flatnonzero(scores > 0)
    if len(at) > k:
        own = scores[at]
        least = own[np.argpartition(-own, k - 1)[k - 1]]
        above = at[own > least]
        at = np.concatenate([above, at[own == least][: k - len(above)]])
    return at[np.lexsort((at, -scores[at]))]


def best_of_shard(ids: int, terms: np.ndarray, begins: np.ndarray, docs: np.ndarray, impacts: np.ndarray, items: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item, place and score of each item's best documents in a shard of ``ids`` documents. items: numbers, where each begins, terms, weights."""
    number, at, term, w = items
    found = np.searchsorted(terms, term)
    known = found < len(terms)
    known[known] = terms[found[known]] == term[known]
    known &= w > 0
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    acc = np.zeros(ids, np.int64)
    for i in range(len(number)):
        own = np.flatnonzero(known[at[i] : at[i + 1]]) + at[i]
        if not len(own):
            continue
        acc[:] = 0
        for j in own.tolist():
            lo, hi = begins[found[j]], begins[found[j] + 1]
            acc[docs[lo:hi]] += w[j] * impacts[lo:hi]
        best = select(acc, k)
        out.append((np.full(len(best), number[i]), best, acc[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def _searched(index: DataFrame, items: list, k: int, kind: str) -> DataFrame:
    """item_no, doc_id, score: each shard's best for a block of items."""
    number = np.array([r["item_no"] for r in items], np.int64)
    at = np.concatenate([[0], np.cumsum([len(r["terms"]) for r in items])]).astype(np.int64)
    sent = index.sparkSession.sparkContext.broadcast((number, at, np.array([t for r in items for t in r["terms"]], np.int64), np.array([w for r in items for w in r["weights"]], np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids = batch.column(0).slice(row, 1).flatten()
                no, place, score = best_of_shard(len(ids), *(numbers(batch, c, row) for c in NUMBERS), sent.value, k)
                yield pa.RecordBatch.from_arrays([pa.array(no), ids.take(pa.array(place)), pa.array(score)], ["item_no", "doc_id", "score"])
        give_back()

    found = index.select("ids", *NUMBERS).mapInArrow(run, f"item_no long, doc_id {kind}, score long")
    return materialize(best(found, k), "found")


def best(found: DataFrame, k: int) -> DataFrame:
    """Adds the rank among the rows of an item and keeps the first k; Spark limits the groups before it exchanges them."""
    w = Window.partitionBy("item_no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(docs: DataFrame, benchmark: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", block_terms: int = BLOCK_TERMS, shard_rows: int = SHARD_ROWS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each item, with scores above 0.

    Null and empty texts have no terms: such documents are never found and don't count, such items find nothing. Rows
    that repeat an id are rows of their own, on either side; equal scores go by doc_id, null ids last. Whole texts are
    read, very long ones too. Terms are equal where their 64-bit hashes are. An empty table gives an empty result; other
    columns are ignored.
    """
    spark = docs.sparkSession
    items = materialize(benchmark.select("item_id", "text").withColumn("item_no", F.monotonically_increasing_id()), "items")
    asked = materialize(item_terms(items), "asked")
    index, some = build_index(docs, id_col, text_col, shard_rows, shard_bytes)
    told = by_run(asked, frequencies(index, asked.select("term").distinct()), ["term"])
    weighed = told.select("item_no", "term", (weight(F.col("df"), some) * F.col("times")).alias("w")).where("w > 0")
    lists = weighed.groupBy("item_no").agg(F.collect_list(F.struct("term", "w")).alias("own"))
    queries = materialize(lists.select("item_no", F.size("own").alias("n"), F.col("own.term").alias("terms"), F.col("own.w").alias("weights")), "queries")
    # Items go in blocks of bounded size, by ranges of a hash of their number.
    cell = F.pmod(F.xxhash64("item_no"), F.lit(CELLS))
    parts = queries.groupBy(cell.alias("cell")).agg(F.sum("n").alias("n"))
    kind = docs.schema[id_col].dataType.simpleString()
    found = None
    for lo, hi in _ranges(parts, block_terms):
        rows = queries.where(cell.between(lo, hi)).collect()
        one = _searched(index, rows, k, kind)
        found = one if found is None else found.unionByName(one)
    drop_scratch(index)
    if found is None:
        found = spark.createDataFrame([], f"item_no long, doc_id {kind}, score long, rank int")
    return found.join(items.select("item_no", "item_id"), "item_no").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _ranges(parts: DataFrame, most: int) -> list[tuple[int, int]]:
    """Ranges of cells (cell, n), in order, that hold at most ``most`` terms each; a larger cell is a range of its own."""
    rows = parts.toArrow()
    order = np.argsort(rows["cell"].to_numpy())
    out: list[list[int]] = []
    held = 0
    for c, n in zip(rows["cell"].to_numpy()[order].tolist(), rows["n"].to_numpy()[order].tolist(), strict=True):
        if out and held + n <= most:
            out[-1][1] = c
            held += n
        else:
            out.append([c, c])
            held = n
    return [(a, b) for a, b in out]


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
n AS (SELECT count(*)::BIGINT AS docs, sum(len(t))::BIGINT AS terms FROM d WHERE len(t) > 0),
p AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, n GROUP BY term, docs),
i AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len * docs) // terms))) AS impact FROM p JOIN w USING (term), n),
s AS (SELECT item_id, doc_id, sum(impact)::BIGINT AS score FROM q JOIN i USING (term) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= {TOP}
"""
