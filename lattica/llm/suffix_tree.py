"""Substring dedup on words: removes every word covered by ``SIZE`` consecutive words that also start anywhere else.

Suffixes are those that begin at anchors: of each window of SIZE words, the least hash of its K-word grams is the
anchor. Equal windows have equal anchors at equal places, so no repeat is lost, and about one word in fourteen begins a
suffix. An anchor stands for a run of neighbouring windows; the words of all of them are its string.

1.  Every document lists its anchors. Those whose gram occurs once have no repeat.
2.  Equal strings are one leaf with a count, so groups of copies of any size are one leaf.
3.  Leaves are partitioned by a prefix of variable length: K words at first. Where a prefix has more leaves than a task
    should hold, each window of them becomes a suffix of its own and the prefix grows, until groups are small or windows
    are equal as a whole. Prefixes with one leaf end there.
4.  Each group's suffix tree is made top-down: a node is split by the next word of its suffixes as long as it has two or
    more. A window with ``a`` words before its anchor is a repeat where the node at depth SIZE - a, deep inside the tree,
    has another leaf with the same ``a`` words before it.
5.  Documents get their repeated windows back and are cut.

Words are equal where their 64-bit hashes are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import arrow_map, by_run, dealt, drop_scratch, materialize, n_partitions, numbered, utf8
from lattica.llm.decontaminate import among, bit_table, gram_hashes
from lattica.llm.suffix_dedup import merge
from lattica.llm.words import mix, sliding_min, spans, word_hashes

SIZE, K = 35, 8
#: Leaves of a prefix that one task holds, and leaves whose trees are made at once.
MEET, CHUNK = 1024, 1 << 15
#: Windows of a document whose anchors are found at once.
BLOCK = 1 << 18
#: Bytes that are no part of a word.
IS_WORD = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's words begin."""
    buf = np.frombuffer(b" ".join(texts), np.uint8)
    starts, ends = spans(buf, IS_WORD)
    at = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    return word_hashes(buf, starts, ends), at


def anchors(words: np.ndarray, size: int, k: int) -> tuple[np.ndarray, ...]:
    """Of one text: first window, windows, the anchor's place in the first window, hashes of gram and string."""
    none = np.zeros(0, np.int64)
    out: list[tuple[np.ndarray, ...]] = []
    for base in range(0, max(0, len(words) - size + 1), BLOCK):
        own = words[base : base + BLOCK + size - 1]
        grams = gram_hashes(own, k)
        low = np.uint64((1 << 20) - 1)
        at = np.arange(len(grams), dtype=np.uint64)
        place = (sliding_min((grams & ~low) | at, size - k + 1) & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        n, place = np.diff(np.append(first, len(place))), place[first]
        # The hash of a range of words, from sums of words times powers of an odd number, whose inverse exists.
        up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(own), SPREAD)]), dtype=np.uint64)
        down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(own), np.uint64(pow(int(SPREAD), -1, 1 << 64)))]), dtype=np.uint64)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(own) * up[:-1], dtype=np.uint64)])
        whole = mix((sums[first + n + size - 1] - sums[first]) * down[first] ^ mix((n * 64 + place - first).astype(np.uint64)))
        out.append((first + base, n, place - first, grams[place], whole))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, none, none, none.astype(np.uint64), none.astype(np.uint64))


ANCHOR = "row_no long, run int, h long, c long, at long, off int, n int"


def document_anchors(docs: DataFrame, size: int, k: int) -> DataFrame:
    """row_no, run, h, c, at, off, n: all anchors of all documents (row_no, text, run)."""

    def run(batch: pa.RecordBatch) -> pa.Table:
        words, begin = words_of(utf8(batch.column(1)))
        each = [anchors(words[a:b], size, k) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
        take = pa.array(np.repeat(np.arange(len(each)), [len(x[0]) for x in each]), pa.int64())
        first, n, off, h, c = (np.concatenate(x) for x in zip(*each, strict=True))
        return pa.table({"row_no": batch.column(0).take(take), "run": batch.column(2).take(take), "h": pa.array(h.view(np.int64)), "c": pa.array(c.view(np.int64)), "at": pa.array(first), "off": pa.array(off.astype(np.int32)), "n": pa.array(n.astype(np.int32))})

    return arrow_map(docs, run, ANCHOR)


def _place_key(row_no: np.ndarray, at: np.ndarray) -> np.ndarray:
    return mix(mix(row_no.astype(np.uint64)) ^ (at.astype(np.uint64) * SPREAD))


def fetch(docs: DataFrame, wanted: DataFrame, size: int, k: int) -> DataFrame:
    """h, c, off, n, words: the strings of the wanted anchors (h, c, row_no, at), read from their documents.

    No text is exchanged: each document lists the strings of its anchors again, only of those that a table of bits of
    bounded size knows by their place, and the join keeps the wanted ones.
    """

    def key(batch: pa.RecordBatch) -> pa.Table:
        return pa.table({"h": pa.array(_place_key(batch.column(0).to_numpy(), batch.column(1).to_numpy()).view(np.int64))})

    places = wanted.select("row_no", "at", F.lit("").alias("_"))
    sent = docs.sparkSession.sparkContext.broadcast(bit_table(materialize(arrow_map(places, key, "h long", 2), "places")))

    def run(batch: pa.RecordBatch) -> pa.Table:
        words, begin = words_of(utf8(batch.column(1)))
        rows = batch.column(0).to_numpy()
        found: list[tuple[np.ndarray, ...]] = []
        lists: list[np.ndarray] = []
        for i, (a, b) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)):
            own = words[a:b]
            first, n, off, h, c = anchors(own, size, k)
            some = np.flatnonzero(among(_place_key(np.full(len(first), rows[i]), first), sent.value))
            found.append((np.full(len(some), rows[i]), first[some], n[some], off[some], h[some].view(np.int64), c[some].view(np.int64)))
            lists += [own[x : x + y + size - 1] for x, y in zip(first[some].tolist(), n[some].tolist(), strict=True)]
        row_no, at, n, off, h, c = (np.concatenate(x) for x in zip(*found, strict=True))
        flat = pa.array(np.concatenate([np.zeros(0, np.uint64), *lists]).view(np.int64))
        ends = np.cumsum([0, *map(len, lists)])
        return pa.table({"row_no": row_no, "at": at, "h": h, "c": c, "off": off.astype(np.int32), "n": n.astype(np.int32), "words": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)})

    listed = arrow_map(docs, run, "row_no long, at long, h long, c long, off int, n int, words array<long>")
    return listed.join(wanted, ["row_no", "at", "h", "c"], "left_semi").drop("row_no", "at")


def ragged(flat: np.ndarray, begin: np.ndarray, length: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of up to ``width`` entries of ``flat`` from ``begin`` on, and how many each has."""
    have = np.minimum(length, width)
    at = np.minimum(begin[:, None] + np.arange(width), max(0, len(flat) - 1))
    return np.where(np.arange(width) < have[:, None], flat[at] if len(flat) else 0, np.uint64(0)), have


def tree_nodes(group: np.ndarray, right: np.ndarray, have: np.ndarray) -> list[np.ndarray]:
    """The suffix trees of all groups, level by level: of each suffix its node at each depth; -1 where it is a leaf alone.

    Suffixes of a node are split by their next word; a node that is left with one suffix is a leaf and is not split on.
    """
    node = np.unique(group, return_inverse=True)[1].astype(np.int64)
    levels = [node]
    for depth in range(right.shape[1]):
        before = levels[-1]
        live = np.flatnonzero((before >= 0) & (have > depth))
        after = np.full(len(before), -1, np.int64)
        order = live[np.lexsort((right[live, depth], before[live]))]
        if len(order):
            new = np.concatenate([[True], (before[order][1:] != before[order][:-1]) | (right[order, depth][1:] != right[order, depth][:-1])])
            child = np.cumsum(new) - 1
            inner = np.bincount(child)[child] > 1
            after[order[inner]] = child[inner]
        levels.append(after)
    return levels


def repeats_in_trees(group: np.ndarray, flat: np.ndarray, begin: np.ndarray, length: np.ndarray, off: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """A flag for each string and window: whether a window of another string of the same group has the same words."""
    right, have = ragged(flat, begin + off, length - off, size)
    levels = tree_nodes(group, right, have)
    out = np.zeros((len(off), int(n.max()) if len(n) else 0), bool)
    behind = np.zeros(len(off), np.uint64)
    for a in range(int(off.max()) + 1 if len(off) else 0):
        if a:
            known = np.flatnonzero(off >= a)
            behind[known] = mix(behind[known] * SPREAD + flat[begin[known] + off[known] - a])
        node = levels[size - a]
        live = np.flatnonzero((off >= a) & (off - n < a) & (node >= 0))
        order = live[np.lexsort((behind[live], node[live]))]
        same = (node[order[1:]] == node[order[:-1]]) & (behind[order[1:]] == behind[order[:-1]])
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = order[twice]
        out[hit, off[hit] - a] = True
    return out


def subtrees(leaves: DataFrame, size: int) -> DataFrame:
    """h, c, lo, runs: of each leaf (g, h, c, lo, off, n, words; in order of g) the runs [lo, hi, ...] of its windows that recur in its group g."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            t = pa.Table.from_batches(held).combine_chunks()
            g = t["g"].to_numpy()
            end = len(g) if last else int(np.searchsorted(g, g[-1]))  # the last group may go on
            if end:
                own = t.slice(0, end).combine_chunks()
                words = own["words"].combine_chunks()
                length = np.diff(words.offsets.to_numpy())
                flags = repeats_in_trees(own["g"].to_numpy(), words.flatten().to_numpy().view(np.uint64), np.cumsum(length) - length, length, own["off"].to_numpy().astype(np.int64), own["n"].to_numpy().astype(np.int64), size)
                row, col = np.nonzero(np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1))
                some = np.unique(row)
                runs = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(row, some), len(row)), pa.int32()), pa.array(col.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(own[x].take(pa.array(some)).combine_chunks() for x in ("h", "c", "lo")), runs], ["h", "c", "lo", "runs"])
            rest = t.slice(end)
            held, rows = rest.to_batches(), rest.num_rows

        for batch in batches:
            for i in range(0, batch.num_rows, CHUNK):
                held.append(batch.slice(i, CHUNK))
                rows += held[-1].num_rows
                if rows >= CHUNK:
                    yield from flush(False)
        if rows:
            yield from flush(True)

    parts = max(n_partitions(leaves.sparkSession), leaves.count() // CHUNK + 1)
    return leaves.repartition(parts, "g").sortWithinPartitions("g").mapInArrow(run, "h long, c long, lo int, runs array<int>")


def longer_prefix(leaves: DataFrame, length: int, size: int) -> tuple[DataFrame, DataFrame]:
    """Each window of the leaves as a leaf of its own, grouped by where the anchor is in it and its first ``length`` words, equal ones once; and h, c, lo, runs of those that are equal. Prefixes with a single leaf are left out."""
    x = leaves.select("g", "h", "c", "lo", "off", "words", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    x = x.select("g", "h", "c", (F.col("lo") + F.col("i")).alias("lo"), (F.col("off") - F.col("i")).alias("off"), F.slice("words", F.col("i") + 1, F.lit(size)).alias("words"))
    x = x.select(F.xxhash64("g", "off", F.slice("words", 1, length)).alias("g"), "h", "c", "lo", F.lit(0).alias("off"), F.lit(1).alias("n"), "words", F.struct(F.xxhash64("words").alias("x"), F.xxhash64("words", F.lit(1)).alias("y")).alias("same"))
    alike = x.groupBy("g", "same").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("c", "lo")).alias("one"))
    told = materialize(by_run(dealt(x, "c"), alike, ["g", "same"]).drop("run", "same"), "longer")
    equal = told.where("m > 1").select("h", "c", "lo", F.array(F.lit(0), F.col("n")).alias("runs"))
    once = told.where((F.col("c") == F.col("one.c")) & (F.col("lo") == F.col("one.lo"))).drop("m", "one")
    return once, equal


def repeats(strings: DataFrame, size: int, k: int, meet: int) -> DataFrame:
    """h, c, runs: of strings (h, c, off, n, words) the runs of windows that another string of the same h has too."""
    leaves = strings.select(F.col("h").alias("g"), "h", "c", F.lit(0).alias("lo"), "off", "n", "words")
    ready, equal, length = [], [], k
    while True:
        sizes = leaves.groupBy("g").agg(F.count(F.lit(1)).alias("m"))
        counts = materialize(sizes.where("m > 1").select("g", (F.col("m") > meet).alias("large")), "prefixes")
        told = materialize(by_run(dealt(leaves, "c"), counts, ["g"]).drop("run"), "told")
        ready.append(told.where("NOT large").drop("large"))
        large = told.where("large").drop("large")
        if length >= size or large.isEmpty():
            break
        length = min(size, 2 * length)
        leaves, same = longer_prefix(large, length, size)
        equal.append(same)
    met = None
    for x in ready:
        met = x if met is None else met.unionByName(x)
    met = subtrees(met, size)
    for x in equal:
        met = met.unionByName(x)
    return met.select("h", "c", F.transform("runs", lambda x: x + F.col("lo")).alias("runs"))


def repeated_spans(docs: DataFrame, size: int = SIZE, k: int = K, meet: int = MEET) -> DataFrame:
    """row_no, spans: word ranges [lo, hi, ...], in no order and overlapping, of repeated windows. ``docs`` has row_no and text."""
    read = docs.select("row_no", "text", F.spark_partition_id().alias("run"))
    listed = materialize(document_anchors(read, size, k), "anchors")
    again = materialize(listed.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("h"), "again")
    shared = materialize(listed.join(again, "h", "left_semi"), "shared")
    drop_scratch(listed)
    one = F.min(F.struct("row_no", "at", "n")).alias("one")
    strings = materialize(shared.groupBy("h", "c").agg(F.count(F.lit(1)).alias("m"), one), "strings")
    several = strings.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("h")
    wanted = materialize(strings.join(several, "h", "left_semi").select("h", "c", "one.row_no", "one.at"), "wanted")
    got = materialize(fetch(read, wanted, size, k), "fetched")
    whole = strings.where("m > 1").select("h", "c", F.array(F.lit(0), F.col("one.n")).alias("runs"))
    found = repeats(got, size, k, meet).unionByName(whole)
    spans = F.transform("runs", lambda x, i: F.col("at") + x + F.when(i % 2 == 1, size - 1).otherwise(0))
    found = materialize(found.groupBy("h", "c").agg(F.flatten(F.collect_list("runs")).alias("runs")), "found")
    out = by_run(shared, found, ["h", "c"]).select("row_no", spans.alias("spans")).groupBy("row_no").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    done = materialize(out, "spans")
    for t in (again, shared, strings, wanted, got, found):
        drop_scratch(t)
    return done


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, k: int = K, meet: int = MEET, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, on request, kept (binary): one row per input row.

    Words are runs of bytes other than white space; null and empty texts have none. Windows are judged on the input, in
    whole texts, however long. Rows that repeat id and text each count as a place. Texts of fewer than ``size`` words stay
    as they are. An empty table gives an empty result; other columns are ignored.
    """
    if not 0 < k <= size < 64:
        raise ValueError("size must be below 64 words, and k at most size")
    docs = numbered(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))[0]
    one = docs.join(repeated_spans(docs, size, k, meet), "row_no", "left").select("doc_id", "text", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batch: pa.RecordBatch) -> pa.Table:
        n, removed, digest, kept = [], [], [], []
        for text, flat in zip(utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            words = text.split()
            left, at = [], 0
            for lo, hi in merge(flat or []):
                left += words[at:lo]
                at = hi
            left += words[at:]
            whole = b" ".join(left)
            n.append(len(words))
            removed.append(len(words) - len(left))
            digest.append(hashlib.sha256(whole).hexdigest())
            kept.append(whole)
        columns = {"doc_id": batch.column(0), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
        return pa.table(columns | ({"kept": pa.array(kept, pa.binary())} if with_text else {}))

    return arrow_map(one, cut, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept binary" * with_text)


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - {SIZE - 2})) AS p, unnest(list_transform(range(1, len(w) - {SIZE - 2}), lambda p: md5(array_to_string(w[p:p + {SIZE - 1}], ' ')))) AS s FROM d WHERE len(w) >= {SIZE}),
r AS (SELECT doc_id, p FROM p WHERE s IN (SELECT s FROM p GROUP BY s HAVING count(*) > 1)),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + {SIZE})) AS i FROM r),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM x ANTI JOIN c USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
