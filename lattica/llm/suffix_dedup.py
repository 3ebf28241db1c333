"""Suffix-array dedup: removes every byte covered by a string of ``SIZE`` bytes that also starts anywhere else.

A suffix array of every byte would not fit a shuffle, so suffixes are sampled in a way that loses none: of each window
of SIZE bytes, the least hash of its K-byte strings is the anchor. Equal windows have equal anchors at equal places.
Neighbouring windows share anchors, so each anchor stands for a run of windows, its string being all their bytes.

1.  Every document lists its anchors: hash of the anchor, hash of the string, place.
2.  Anchors whose hash occurs once are done. Equal strings are one entry with a count; with a count of two or more all
    their windows are repeated, however large the group of copies is.
3.  Of hashes that have several different strings, one of each string is fetched. Strings of one anchor meet, are
    ordered by deep-shallow suffix sorting, and equal windows found along that order (``suffix_sort``). Where an anchor
    has more than ``MEET`` strings, its group is first split by more of the bytes around it: windows are classed by where
    the anchor stands in them, all windows of a class hold the same bytes before and after it, and these are the new
    group. Classes are halved until groups are small; equal pieces are repeats and go on as one.
4.  Documents get their repeated windows back and are cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import arrow_map, by_run, dealt, drop_scratch, materialize, n_partitions, numbered, utf8
from lattica.llm.suffix_sort import repeated_windows
from lattica.llm.words import mix, range_hashes, sliding_min

SIZE, K = 200, 32
#: Bytes of one document whose anchors are found at once.
BLOCK = 1 << 20
#: Strings of one group that are sorted together.
MEET = 1024
#: Strings that a task sorts at once.
CHUNK = 1 << 15
PLACE_BITS = 22


def gram_hash(buf: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k bytes, k a power of two, by doubling."""
    h = mix(buf.astype(np.uint64) + np.uint64(0x51ED27))
    have = 1
    while have < k:
        h = mix(h[:-have] * np.uint64(0x9FB21C651E98DF25) + (h[have:] ^ np.uint64(have)))
        have *= 2
    return h


def anchors(buf: np.ndarray, ends: np.ndarray, size: int = SIZE, k: int = K) -> tuple[np.ndarray, ...]:
    """Of texts that end at ``ends`` in the block: text, first window, anchor's offset in it, windows, and hashes of anchor and string."""
    n = len(buf) - size + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    h = gram_hash(buf, k)
    at = np.arange(len(h), dtype=np.uint64)
    low = np.uint64((1 << PLACE_BITS) - 1)
    place = (sliding_min((h & ~low) | at, size - k + 1) & low).astype(np.int64)
    begin = np.concatenate([[0], ends[:-1]])
    text = np.repeat(np.arange(len(ends)), np.maximum(ends - begin - size + 1, 0))
    ok = np.concatenate([np.arange(b, e - size + 1) for b, e in zip(begin.tolist(), ends.tolist(), strict=True)] or [none])
    if not len(ok):
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    p = place[ok]
    new = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (text[1:] != text[:-1])]))
    first, count = ok[new], np.diff(np.append(new, len(ok)))
    p, text = p[new], text[new]
    whole = range_hashes(buf, first, first + count + size - 1, 5) ^ mix((p - first).astype(np.uint64))
    return text, first - begin[text], p - first, count, h[p], whole


def document_anchors(docs: DataFrame, size: int, k: int) -> DataFrame:
    """row_no, run, h, c, at, off, n: all anchors of all documents (row_no, text, run)."""

    def run(batch: pa.RecordBatch) -> pa.Table:
        texts = utf8(batch.column(1))
        found: list[tuple[np.ndarray, ...]] = []
        # Long texts go in overlapping blocks, so that every window is in just one of them.
        parts = [(i, a, t[a : a + BLOCK + size - 1]) for i, t in enumerate(texts) for a in range(0, max(1, len(t) - size + 1), BLOCK)]
        at = 0
        while at < len(parts):
            to, held = at, 0
            while to < len(parts) and (to == at or held + len(parts[to][2]) <= BLOCK):
                held += len(parts[to][2])
                to += 1
            block = parts[at:to]
            text, first, off, count, h, c = anchors(np.frombuffer(b"".join(x[2] for x in block), np.uint8), np.cumsum([len(x[2]) for x in block]), size, k)
            which, base = np.array([x[0] for x in block]), np.array([x[1] for x in block])
            found.append((which[text], first + base[text], off, count, h, c))
            at = to
        text, first, off, count, h, c = (np.concatenate(x) for x in zip(*found, strict=True)) if found else anchors(np.zeros(0, np.uint8), np.zeros(0, np.int64))
        take = pa.array(text.astype(np.int64))
        return pa.table({"row_no": batch.column(0).take(take), "run": batch.column(2).take(take), "h": pa.array(h.view(np.int64)), "c": pa.array(c.view(np.int64)), "at": pa.array(first.astype(np.int64)), "off": pa.array(off.astype(np.int32)), "n": pa.array(count.astype(np.int32))})

    return arrow_map(docs, run, "row_no long, run int, h long, c long, at long, off int, n int")


def fetch(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """h, c, off, n, string: the strings of the wanted anchors (row_no, h, c, at, off, n; each h and c once), cut from their documents."""
    lists = wanted.groupBy("row_no").agg(F.collect_list(F.struct("h", "c", "at", "off", "n")).alias("wanted"))
    one = docs.join(lists, "row_no").select("row_no", "text", "wanted")

    def cut(batch: pa.RecordBatch) -> pa.Table:
        h, c, off, n, s = [], [], [], [], []
        for text, want in zip(utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            for w in want:
                h.append(w["h"])
                c.append(w["c"])
                off.append(w["off"])
                n.append(w["n"])
                s.append(text[w["at"] : w["at"] + w["n"] + size - 1])
        return pa.table({"h": pa.array(h, pa.int64()), "c": pa.array(c, pa.int64()), "off": pa.array(off, pa.int32()), "n": pa.array(n, pa.int32()), "string": pa.array(s, pa.binary())})

    return arrow_map(one, cut, "h long, c long, off int, n int, string binary")


def sorted_repeats(strings: DataFrame, size: int) -> DataFrame:
    """h, c, lo, runs: of each piece (g, h, c, lo, off, n, string; in order of g) the runs [lo, hi, ...] of windows that another piece of its group g has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            t = pa.Table.from_batches(held)
            g = t["g"].to_numpy()
            end = len(g) if last else int(np.searchsorted(g, g[-1]))  # the last group may go on
            if end:
                own = t.slice(0, end)
                gg, off, n = own["g"].to_numpy(), own["off"].to_numpy().astype(np.int64), own["n"].to_numpy().astype(np.int64)
                group = np.cumsum(np.concatenate([[0], gg[1:] != gg[:-1]]))
                flags = repeated_windows(own["string"].to_pylist(), off, n, group, size)
                runs = []
                edges = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
                row, col = np.nonzero(edges)
                for part in np.split(col, np.searchsorted(row, np.arange(1, len(flags)))):
                    runs.append(part.tolist())
                yield pa.RecordBatch.from_arrays([*(own[x].combine_chunks() for x in ("h", "c", "lo")), pa.array(runs, pa.list_(pa.int32()))], ["h", "c", "lo", "runs"])
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

    return strings.mapInArrow(run, "h long, c long, lo int, runs array<int>")


def split(pieces: DataFrame, width: int, size: int, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The pieces cut by classes of ``width`` places of the anchor in a window, each in a group by the bytes its windows share, equal ones once; h, c, lo, runs of pieces that are equal; and the table that both read.

    A window's place is the number of bytes before its anchor. Windows of places p to p + width - 1 all hold the p bytes
    before the anchor and the size - p - width + 1 bytes from it on.
    """
    classes = F.sequence(F.floor((F.col("off") - F.col("n") + 1) / width).cast("int"), F.floor(F.col("off") / width).cast("int"))
    x = pieces.select("g", "h", "c", "lo", "off", "n", "string", F.explode(classes).alias("of")).withColumn("p", F.col("of") * width)
    x = x.withColumns({"least": F.greatest("p", F.col("off") - F.col("n") + 1), "most": F.least(F.col("p") + width - 1, F.col("off"))})
    x = x.select("g", "h", "c", "of", "p", (F.col("lo") + F.col("off") - F.col("most")).alias("lo"), F.col("most").alias("off"), (F.col("most") - F.col("least") + 1).alias("n"),
                 F.substring("string", F.col("off") - F.col("most") + 1, F.col("most") - F.col("least") + size).alias("string"))
    known = F.substring("string", F.col("off") - F.col("p") + 1, F.col("p") + F.greatest(F.lit(k), size - F.col("p") - width + 1))
    x = x.select(F.xxhash64("g", F.lit(width), "of", known).alias("g"), "h", "c", "lo", "off", "n", "string", F.struct("off", "n", F.xxhash64("string").alias("x"), F.xxhash64("string", F.lit(1)).alias("y")).alias("same"))
    alike = x.groupBy("g", "same").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("first"))
    told = materialize(by_run(dealt(x, "c"), alike, ["g", "same"]).drop("run", "same"), "pieces")
    equal = told.where("m > 1").select("h", "c", "lo", F.array(F.lit(0), F.col("n")).alias("runs"))
    return told.where("c = first").select("g", "h", "c", "lo", "off", "n", "string"), equal, told


def repeats(strings: DataFrame, size: int, k: int, meet: int) -> tuple[DataFrame, list[DataFrame]]:
    """h, c, runs, and the tables that this still reads, to be dropped after it: of strings (h, c, off, n, string) the runs of windows that another string of the same h has too; large groups are split until at most ``meet`` strings are sorted together."""
    pieces, width = strings.select(F.col("h").alias("g"), "h", "c", F.lit(0).alias("lo"), "off", "n", "string"), size - k + 1
    small, equal, made = None, None, []
    while width > 1:
        large = materialize(pieces.groupBy("g").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > meet).select("g", F.lit(True).alias("large")), "large")
        if large.isEmpty():
            break
        told = materialize(by_run(dealt(pieces, "c"), large, ["g"], "left").drop("run"), "told")
        drop_scratch(large)
        made.append(told)
        ready = told.where("large IS NULL").drop("large")
        small = ready if small is None else small.unionByName(ready)
        width = -(-width // 2)
        pieces, same, both = split(told.where("large").drop("large"), width, size, k)
        made.append(both)
        equal = same if equal is None else equal.unionByName(same)
    pieces = pieces if small is None else small.unionByName(pieces)
    parts = max(n_partitions(strings.sparkSession), strings.count() // CHUNK + 1)
    met = sorted_repeats(pieces.repartition(parts, "g").sortWithinPartitions("g"), size)
    met = (met if equal is None else met.unionByName(equal)).where(F.size("runs") > 0)
    return met.select("h", "c", F.transform("runs", lambda x: x + F.col("lo")).alias("runs")), made


def repeated_spans(docs: DataFrame, size: int = SIZE, k: int = K, meet: int = MEET) -> DataFrame:
    """row_no, spans: byte ranges [lo, hi, ...], in no order and overlapping, of repeated strings of ``size`` bytes. ``docs`` has row_no and text."""
    listed = materialize(document_anchors(docs.select("row_no", "text", F.spark_partition_id().alias("run")), size, k), "anchors")
    # As a table of its own, so that the join's two sides are plain exchanges, of which Spark can split a hot hash.
    again = materialize(listed.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("h"), "again")
    shared = materialize(listed.join(again, "h", "left_semi"), "shared")
    drop_scratch(listed)
    one = F.min(F.struct("row_no", "at", "off", "n")).alias("one")
    strings = materialize(shared.groupBy("h", "c").agg(F.count(F.lit(1)).alias("m"), one), "strings")
    several = materialize(strings.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("h"), "several")
    wanted = strings.join(several, "h").select("one.*", "h", "c")
    got = materialize(fetch(docs, wanted, size), "fetched")
    whole = strings.where("m > 1").select("h", "c", F.array(F.lit(0), F.col("one.n")).alias("runs"))
    again_found, made = repeats(got, size, k, meet)
    found = again_found.join(strings.where("m > 1").select("h", "c"), ["h", "c"], "left_anti").unionByName(whole)
    spans = F.transform("runs", lambda x, i: F.col("at") + x + F.when(i % 2 == 1, size - 1).otherwise(0))
    out = by_run(shared, found, ["h", "c"]).select("row_no", spans.alias("spans")).groupBy("row_no").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    done = materialize(out, "spans")
    for t in (again, shared, strings, several, got, *made):
        drop_scratch(t)
    return done


def merge(spans: list[int]) -> list[tuple[int, int]]:
    """Maximal ranges of flat, unordered ranges."""
    if not spans:
        return []
    x = np.array(spans, np.int64).reshape(-1, 2)
    x = x[np.argsort(x[:, 0])]
    reach = np.maximum.accumulate(x[:, 1])
    new = np.flatnonzero(np.concatenate([[True], x[1:, 0] > reach[:-1]]))
    return list(zip(x[new, 0].tolist(), reach[np.append(new[1:] - 1, len(x) - 1)].tolist(), strict=True))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, k: int = K, meet: int = MEET, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, on request, kept (binary): one row per input row.

    Texts are UTF-8 bytes, null is empty; matches never cross documents. Strings are judged on the input. Rows that
    repeat id and text each count as a place of their strings. Texts shorter than ``size`` bytes stay as they are. An
    empty table gives an empty result; other columns are ignored.
    """
    docs = numbered(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))[0]
    one = docs.join(repeated_spans(docs, size, k, meet), "row_no", "left").select("doc_id", "text", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batch: pa.RecordBatch) -> pa.Table:
        size_of, removed, count, digest, kept = [], [], [], [], []
        for text, flat in zip(utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            ranges = merge(flat or [])
            ends = [0, *(hi for _, hi in ranges)]
            rest = b"".join(text[a:b] for a, b in zip(ends, [*(lo for lo, _ in ranges), len(text)], strict=True))
            size_of.append(len(text))
            removed.append(len(text) - len(rest))
            count.append(len(ranges))
            digest.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest)
        columns = {"doc_id": batch.column(0), "n_bytes": pa.array(size_of, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(count, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
        return pa.table(columns | ({"kept": pa.array(kept, pa.binary())} if with_text else {}))

    return arrow_map(one, cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
