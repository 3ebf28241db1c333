"""Benchmark decontamination by winnowing.

Of the hashes of ``K`` successive words, the minimum of each ``W`` neighbours is kept, in documents and in items, so
that any shared span of K + W - 1 = 10 words holds a fingerprint that both have kept. Items of fewer than 10 words are
one window and are kept whole.

1.  Items become passages: a fingerprint and up to five words on either side, which is all that a window of ten words
    around it can hold. Equal passages of many items are one.
2.  One narrow pass over the documents lists their fingerprints with the words around, those only that pass a bit table
    of the passages' hashes. The table has a fixed largest size; it saves work and decides nothing.
3.  Distinct fingerprints of documents and passages are joined by hash and three more words on one side (spans of ten
    words have them on one side at least) and extended word by word; spans of ten words or more are hits.
4.  Hits go back to the documents, run by run, so a line that very many documents hold is no hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import arrow_map, by_run, materialize, numbered, of_numbers, utf8
from lattica.llm.words import LOWER, mix, sliding_min, spans, word_hashes

SPAN, K, W = 10, 5, 6
SIDE = SPAN - K
#: Bits of the table of hashes for each passage, and at most.
BITS_EACH, BITS_MOST = 16, 1 << 27
IS_WORD = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k successive words."""
    n = max(0, len(words) - k + 1)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * STEP + words[i : i + n]
    return mix(h)


def kept(grams: np.ndarray, w: int = W) -> np.ndarray:
    """Places whose hash is the minimum of some w neighbours; all places of equal minima are kept."""
    if len(grams) < w:
        return np.flatnonzero(grams == grams.min()) if len(grams) else np.empty(0, np.int64)
    least = sliding_min(grams, w)
    flags = np.zeros(len(grams), bool)
    for d in range(w):
        flags[d : d + len(least)] |= grams[d : d + len(least)] == least
    return np.flatnonzero(flags)


def short_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n successive words, apart from those of other lengths."""
    return mix(gram_hashes(words, n) ^ np.uint64(n))


PASSAGE = "n int, h long, before array<long>, after array<long>"
LONGS = pa.list_(pa.int64())


def passages(benchmark: DataFrame) -> DataFrame:
    """item_id (as string), n, h, before, after: the kept fingerprints of items, with the words before (nearest first) and after; n is 0, or the number of words of a short item, whose words are all in ``after``."""

    def run(batch: pa.RecordBatch) -> pa.Table:
        at, n, h, before, after = [], [], [], [], []
        for i, text in enumerate(utf8(batch.column(1))):
            buf = np.frombuffer(text.translate(LOWER), np.uint8)
            w = word_hashes(buf, *spans(buf, IS_WORD))
            signed = w.view(np.int64)
            if len(w) >= SPAN:
                g = gram_hashes(w, K)
                for j in kept(g).tolist():
                    at.append(i)
                    n.append(0)
                    h.append(int(g[j : j + 1].view(np.int64)[0]))
                    before.append(signed[max(0, j - SIDE) : j][::-1].tolist())
                    after.append(signed[j + K : j + SPAN].tolist())
            elif len(w):
                at.append(i)
                n.append(len(w))
                h.append(int(short_hashes(w, len(w)).view(np.int64)[0]))
                before.append([])
                after.append(signed.tolist())
        return pa.table({"item_id": batch.column(0).take(pa.array(at, pa.int64())), "n": pa.array(n, pa.int32()), "h": pa.array(h, pa.int64()), "before": pa.array(before, LONGS), "after": pa.array(after, LONGS)})

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    return arrow_map(items, run, f"item_id string, {PASSAGE}")


def bit_table(found: DataFrame) -> np.ndarray:
    """A bit for each hash of the passages, by its low bits; the table's size is bounded, so it may be collected."""
    count = found.count()
    size = 1 << min(BITS_MOST.bit_length() - 1, max(6, (BITS_EACH * count).bit_length()))
    slot = F.call_function("shiftrightunsigned", F.col("h").bitwiseAND(F.lit(size - 1)), F.lit(6))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))
    rows = found.groupBy(slot.alias("slot")).agg(F.bit_or(bit).alias("bits")).toArrow()
    table = np.zeros(size >> 6, np.uint64)
    table[rows["slot"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return table


def among(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = h & np.uint64((len(table) << 6) - 1)
    return (table[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def marks(texts: list[bytes], table: np.ndarray, lengths: list[int]) -> tuple[list[int], list[list[dict]]]:
    """Words of each text; and of each text the fingerprints that pass the table, equal ones with equal words around them once, with their places."""
    buf = np.frombuffer(b" ".join(texts).translate(LOWER), np.uint8)
    starts, ends = spans(buf, IS_WORD)
    words = word_hashes(buf, starts, ends)
    bound = np.concatenate([[0], np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))])
    doc_of = np.repeat(np.arange(len(texts)), np.diff(bound))
    signed = words.view(np.int64)
    found: list[dict[tuple, list[int]]] = [{} for _ in texts]
    grams = gram_hashes(words, K)
    if len(grams):
        inside = doc_of[: len(grams)] == doc_of[K - 1 :]
        places = kept(np.where(inside, grams, np.uint64(0xFFFFFFFFFFFFFFFF)))
        places = places[inside[places] & among(grams[places], table)]
        for i, h in zip(places.tolist(), grams[places].view(np.int64).tolist(), strict=True):
            d = int(doc_of[i])
            lo, hi = int(bound[d]), int(bound[d + 1])
            key = (0, h, tuple(signed[max(lo, i - SIDE) : i][::-1].tolist()), tuple(signed[i + K : min(hi, i + SPAN)].tolist()))
            found[d].setdefault(key, []).append(i - lo)
    for n in lengths:
        short = short_hashes(words, n)
        if not len(short):
            continue
        places = np.flatnonzero(among(short, table) & (doc_of[: len(short)] == doc_of[n - 1 :]))
        for i, h in zip(places.tolist(), short[places].view(np.int64).tolist(), strict=True):
            d = int(doc_of[i])
            found[d].setdefault((n, h, (), tuple(signed[i : i + n].tolist())), []).append(i - int(bound[d]))
    return np.diff(bound).tolist(), [[{"n": k[0], "h": k[1], "before": k[2], "after": k[3], "at": at} for k, at in f.items()] for f in found]


MARKS = pa.list_(pa.struct([("n", pa.int32()), ("h", pa.int64()), ("before", LONGS), ("after", LONGS), ("at", pa.list_(pa.int32()))]))


def marked(docs: DataFrame, table: np.ndarray, lengths: list[int]) -> DataFrame:
    """doc_id, row_no, run, n_words, marks of documents (doc_id, text, row_no, run); rows stay where they are."""
    sent = docs.sparkSession.sparkContext.broadcast((table, lengths))

    def run(batch: pa.RecordBatch) -> pa.Table:
        n, found = marks(utf8(batch.column(1)), *sent.value)
        return pa.table({"doc_id": batch.column(0), "row_no": batch.column(2), "run": batch.column(3), "n_words": pa.array(n, pa.int64()), "marks": pa.array(found, MARKS)})

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs, run, f"doc_id {id_type}, row_no long, run int, n_words long, marks array<struct<n:int,h:long,before:array<long>,after:array<long>,at:array<int>>>")


def _common(a: str, b: str) -> Column:
    """Leading entries that two arrays share."""
    equal = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.array_position(F.concat(equal, F.array(F.lit(False))), False).cast("int") - 1


def _keyed(x: DataFrame) -> DataFrame:
    """Each fingerprint under its hash and three more words on each side that has them; short items under their hash."""
    near = F.lit(SIDE // 2 + 1)
    side = lambda c: F.when((F.col("n") == 0) & (F.size(c) >= near), F.xxhash64("h", F.lit(c), F.slice(c, F.lit(1), near)))
    return x.withColumn("key", F.explode(F.array_compact(F.array(F.when(F.col("n") > 0, F.col("h")), side("before"), side("after")))))


def _name() -> Column:
    return F.xxhash64("n", "h", "before", "after")


class Leaks:
    """The marks of all documents, and what they share with passages.

    ``marks`` has doc_id, row_no, run, n_words and marks; ``around`` says of each fingerprint that is hit (mark) how far
    the hits reach from it (lo, hi), and ``items`` which items they are of (mark, item_id).
    """

    def __init__(self, docs: DataFrame, benchmark: DataFrame) -> None:
        own = materialize(passages(benchmark), "passages")
        lengths = [r["n"] for r in own.where("n > 0").select("n").distinct().collect()]  # at most nine numbers
        self.marks = materialize(marked(docs, bit_table(own), sorted(lengths)), "marks")
        known = own.select("n", "h", "before", "after").distinct().withColumn("passage", _name())
        asked = self.marks.select(F.inline("marks")).select("n", "h", "before", "after").distinct().withColumn("mark", _name())
        theirs = _keyed(known).select("key", F.col("n").alias("n2"), F.col("h").alias("h2"), F.col("before").alias("before2"), F.col("after").alias("after2"), "passage")
        pairs = _keyed(asked).join(theirs, "key").where("n = n2 AND h = h2").select("mark", "passage", "n", _common("before", "before2").alias("l"), _common("after", "after2").alias("r"))
        whole = F.when(F.col("n") == 0, F.col("l") + F.col("r") >= SIDE).otherwise(F.col("r") == F.col("n"))
        pairs = materialize(pairs.where(whole), "pairs")
        self.around = pairs.groupBy("mark").agg(F.max(F.when(F.col("n") == 0, F.col("l")).otherwise(0)).alias("lo"), F.max(F.when(F.col("n") == 0, F.col("r") + K).otherwise(F.col("n"))).alias("hi"))
        of = own.select(_name().alias("passage"), "item_id").distinct()
        self.items = pairs.select("mark", "passage").distinct().join(of, "passage").select("mark", "item_id").distinct()
        self.found = self.marks.where(F.size("marks") > 0).select("row_no", "run", F.inline("marks")).select("row_no", "run", "at", _name().alias("mark"))

    def rows(self) -> DataFrame:
        """row_no of documents that are hit."""
        return by_run(self.found, self.around, ["mark"]).select("row_no").distinct()


def remove_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows, with all columns, in which no window of the benchmark occurs.

    Null and empty texts have no words and stay; repeated rows get the same answer; columns may have any names. An empty
    table gives an empty result; without items all rows stay. Very long texts are read whole.
    """
    rows, number = numbered(docs)
    read = rows.select(F.lit(0).alias("doc_id"), F.col(text_col).alias("text"), F.col(number).alias("row_no"), F.spark_partition_id().alias("run"))
    return of_numbers(rows, number, materialize(Leaks(read, benchmark).rows(), "leaks"), "left_anti")


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs, items: one row per document; runs are hit word ranges [lo, hi, ...], items the sorted, distinct item ids.

    Null and empty texts have no words. Items without words have no window. Items with a null id are hit like others; all
    of them are one null at the end of the items, which counts in ``n_items`` and is left out of the digest. With no item
    at all, nothing is hit. Repeated rows get the same answer. An empty table gives an empty result. Other columns are ignored.
    """
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row_no"), F.spark_partition_id().alias("run"))
    leaks = Leaks(read, benchmark)
    hits = by_run(leaks.found, leaks.around, ["mark"]).groupBy("row_no").agg(F.collect_list(F.struct("at", "lo", "hi")).alias("hits"))
    by_null = F.struct(F.col("item_id").isNull().alias("none"), "item_id")
    named = by_run(leaks.found.select("row_no", "run", "mark").distinct(), leaks.items, ["mark"]).groupBy("row_no").agg(F.array_sort(F.collect_set(by_null)).alias("named"))
    rows = leaks.marks.select("doc_id", "row_no", "n_words", F.size("marks").alias("m"))
    some = rows.where("m > 0").join(hits.join(named, "row_no"), "row_no", "left").select("doc_id", "n_words", "hits", F.transform("named", lambda x: x["item_id"]).alias("items"))
    none = rows.where("m = 0").select("doc_id", "n_words", F.array().cast("array<int>").alias("runs"), F.array().cast("array<string>").alias("items"))

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = [union(v or []) for v in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(runs, pa.list_(pa.int32())), pa.array([v or [] for v in b.column(3).to_pylist()], pa.list_(pa.string()))], ["doc_id", "n_words", "runs", "items"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return some.mapInArrow(unite, f"doc_id {id_type}, n_words long, runs array<int>, items array<string>").unionByName(none)


def union(hits: list[dict]) -> list[int]:
    """Maximal ranges [lo, hi, ...] around the places of hits."""
    if not hits:
        return []
    lo = np.concatenate([np.array(x["at"], np.int64) - x["lo"] for x in hits])
    hi = np.concatenate([np.array(x["at"], np.int64) + x["hi"] for x in hits])
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order])
    new = np.flatnonzero(np.concatenate([[True], lo[1:] > reach[:-1]]))
    return np.stack([lo[new], reach[np.append(new[1:] - 1, len(lo) - 1)]], axis=1).ravel().tolist()


def leak_digests(leaks: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, from the runs and items of ``find_leaks``."""
    pairs = F.sequence(F.lit(0), F.size("runs") - 2, F.lit(2))
    plain = F.when(F.size("runs") == 0, F.lit(0)).otherwise(F.aggregate(pairs, F.lit(0), lambda a, i: a + F.get("runs", i + 1) - F.get("runs", i)))
    return leaks.withColumn("n_hit", plain.cast("long")).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT item_id, least(len(w), {SPAN}) AS n, unnest(list_transform(range(1, len(w) - least(len(w), {SPAN}) + 2), lambda p: array_to_string(w[p:p + least(len(w), {SPAN}) - 1], ' '))) AS s FROM i WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS p, unnest(list_transform(range(1, len(w) - n + 2), lambda p: array_to_string(w[p:p + n - 1], ' '))) AS s FROM d, ns WHERE len(w) >= n),
h AS (SELECT doc_id, item_id, p, dw.n FROM dw JOIN iw ON dw.n = iw.n AND dw.s = iw.s),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY 1),
x AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN x USING (doc_id)
"""
