"""Operators with exact results, against brute force on small fixtures that hold nulls, ties, repeats and clashing columns."""

import collections
import hashlib
import json
import random
import re
import textwrap

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lattica.llm import bpe, chat, common, decontaminate, exact_dedup, licenses, queries, sharding, simhash, suffix_dedup, suffix_sort

#: Columns beside doc_id and text that bear names the operators use themselves.
CLASH = "rid long, h long, fp long, kept boolean, score double, run int, hot boolean, label string"


def frame(spark, texts, ids=None, parts=3):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, 1, 2, 3, True, 0.5, 7, False, None) for i, t in zip(ids, texts, strict=True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + CLASH)
    return df.repartition(parts) if rows else df


def corpus(seed=1, n=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7)))
    passage = " ".join(word() for _ in range(90))
    texts = [" ".join(word() for _ in range(rng.randint(0, 150))) for _ in range(n)]
    for i in range(0, n, 5):
        at = rng.randint(0, len(texts[i]))
        texts[i] = texts[i][:at] + passage[rng.randint(0, 60) :] + texts[i][at:]
    texts += [texts[0], texts[0], texts[5].replace(" ", "\n\t"), texts[7] + " extra", "", " \n", None, "Of " * 200, "Of " * 200 + "x", "ÀÉ" * 150, passage[:210]]
    return texts


@pytest.fixture(scope="module")
def texts():
    return corpus()


def collected(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# --- suffix-array dedup


def brute_repeats(rows, size):
    count = collections.Counter(t[s : s + size] for _, t in rows for s in range(len(t) - size + 1))
    out = []
    for i, t in rows:
        covered = [False] * len(t)
        for s in range(len(t) - size + 1):
            if count[t[s : s + size]] > 1:
                covered[s : s + size] = [True] * size
        kept = bytes(b for b, c in zip(t, covered, strict=True) if not c)
        runs = sum(c and not (k and covered[k - 1]) for k, c in enumerate(covered))
        out.append((i, len(t), sum(covered), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("meet", [1024, 1])
def test_suffix_dedup(spark, texts, meet):
    got = suffix_dedup.suffix_dedup(frame(spark, texts), meet=meet)
    want = brute_repeats([(i, (t or "").encode()) for i, t in enumerate(texts)], 200)
    assert collected(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert sum(w[2] for w in want) > 1000


@pytest.mark.parametrize("meet", [1024, 3, 1])
def test_suffix_dedup_small_window(spark, meet):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(30)]
    got = suffix_dedup.suffix_dedup(frame(spark, texts), size=12, k=4, meet=meet, with_text=True)
    want = brute_repeats([(i, t.encode()) for i, t in enumerate(texts)], 12)
    assert collected(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got.collect())


def test_suffix_dedup_repeated_rows_and_null_ids(spark):
    t = "".join(random.Random(2).choice("abcdef") for _ in range(300))
    got = suffix_dedup.suffix_dedup(frame(spark, [t, t, t[:250], "x" * 150], ids=[1, 1, None, None]))
    assert collected(got, "doc_id", "n_removed") == [(1, 300), (1, 300), (None, 0), (None, 250)]


def test_suffix_dedup_blocks_of_a_long_text(spark, monkeypatch):
    # Blocks far smaller than the text, and one text longer than the real block.
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    texts = [long, long[500:1900], "z" * 5 + long[2500:]]
    monkeypatch.setattr(suffix_dedup, "BLOCK", 256)
    rows = [(i, t.encode()) for i, t in enumerate(texts)]
    buf = np.frombuffer(rows[0][1], np.uint8)
    whole = suffix_dedup.anchors(buf, np.array([len(buf)]))
    assert int(whole[3].sum()) == len(buf) - 199
    got = suffix_dedup.suffix_dedup(frame(spark, texts))
    assert collected(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(rows, 200)


def test_suffix_dedup_of_one_hot_line(spark):
    """A line that most texts hold, each with other words around it, and some with equal words on one side."""
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    line, left, right = word(60), [word(120) for _ in range(6)], [word(120) for _ in range(6)]
    texts = [rng.choice([word(120), word(100) + rng.choice(left)[-rng.randint(1, 120) :]]) + line + rng.choice([word(120), rng.choice(right)[: rng.randint(1, 120)] + word(100)]) for _ in range(80)]
    want = brute_repeats([(i, t.encode()) for i, t in enumerate(texts)], 200)
    for meet in (1024, 10):
        assert collected(suffix_dedup.suffix_dedup(frame(spark, texts), meet=meet), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert sum(w[2] for w in want) > 500


def test_deep_shallow_order():
    rng = random.Random(3)
    for _ in range(20):
        base = bytes(rng.choice(b"ab") for _ in range(120))
        strings = [base[: rng.randint(1, 110)] + bytes(rng.choice(b"\0ab") for _ in range(rng.randint(0, 9))) for _ in range(40)]
        sizes = np.array([len(s) for s in strings])
        rows = np.frombuffer(b"".join(s.ljust(128, b"\0") for s in strings), np.uint8).reshape(-1, 128)
        order, common = suffix_sort.deep_shallow(rows, sizes, np.zeros(len(strings), np.int64))
        assert [(strings[i].ljust(128, b"\0"), len(strings[i])) for i in order] == sorted((s.ljust(128, b"\0"), len(s)) for s in strings)
        for a, b, c in zip(order, order[1:], common[1:], strict=False):
            x, y = strings[a], strings[b]
            k = 0
            while k < min(len(x), len(y)) and x[k] == y[k]:
                k += 1
            assert k == c


# --- decontamination


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_leaks(rows, items):
    out = []
    for i, t in rows:
        w, hit, ids = words(t), set(), set()
        for k, it in items:
            x = words(it)
            n = min(len(x), 10)
            wins = {tuple(x[j : j + n]) for j in range(len(x) - n + 1)} if x else set()
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in wins:
                    hit |= set(range(p, p + n))
                    ids.add(str(k))
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def leak_fixture():
    rng = random.Random(6)
    sent = lambda n: " ".join(rng.choice(["Red", "fox", "été", "7", "jumps", "over", "dog", "lazy", "moon", "sky"]) + rng.choice(["", "", ",", "."]) for _ in range(n))
    items = [(i, sent(n)) for i, n in enumerate([30, 25, 10, 9, 4, 1, 40])] + [(7, ""), (8, None), (9, "!?"), (2, "again " + sent(12))]
    docs = [sent(rng.randint(0, 60)) for _ in range(20)]
    for i, (_, t) in enumerate(items):
        if t:
            w = t.split()
            docs.append(sent(5) + " " + " ".join(w[: 3 + i * 3]).upper() + " " + sent(5))
            docs.append(" - ".join(w))
    return [*docs, None, "", "fox " * 50], items


@pytest.mark.parametrize("bits", [1 << 27, 64])
def test_decontaminate(spark, monkeypatch, bits):
    monkeypatch.setattr(decontaminate, "BITS_MOST", bits)
    docs, items = leak_fixture()
    bench = spark.createDataFrame(items, "item_id long, text string")
    leaks = decontaminate.leak_digests(decontaminate.find_leaks(frame(spark, docs), bench))
    want = brute_leaks(list(enumerate(docs)), items)
    assert collected(leaks, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want
    assert 3 < sum(w[5] for w in want) < len(want)
    kept = decontaminate.remove_leaks(frame(spark, docs), bench)
    assert collected(kept, "doc_id") == sorted(((w[0],) for w in want if not w[5]), key=repr)
    assert kept.columns == frame(spark, docs).columns


def test_decontaminate_repeated_and_null_items(spark):
    a, b, c = ("one two three four five six seven eight nine ten", "red fox jumps over the lazy dog at the moon", "Eins zwei")
    items = [(1, a), (1, a), (1, a), (1, b), (None, b), (None, c), (None, c), (2, c)]
    docs = [f"x {a} y", f"{b}. {a}", f"so {c}!", "nothing", b]
    bench = spark.createDataFrame(items, "item_id long, text string")
    leaks = decontaminate.leak_digests(decontaminate.find_leaks(frame(spark, docs), bench))
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(0, 10, 1, digest("1")), (1, 20, 2, digest("1")), (2, 2, 2, digest("2")), (3, 0, 0, digest("")), (4, 10, 2, digest("1"))]
    assert collected(leaks, "doc_id", "n_hit", "n_items", "items_sha256") == want

    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR); CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(docs)))
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    assert sorted(con.sql(f"SELECT doc_id, n_hit, n_items, items_sha256 FROM ({decontaminate.ORACLE_SQL})").fetchall()) == want
    assert collected(decontaminate.remove_leaks(frame(spark, docs), bench.where("item_id IS NULL")), "doc_id") == [(0,), (3,)]


def test_decontaminate_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert collected(decontaminate.leak_digests(decontaminate.find_leaks(frame(spark, ["a b"]), none)), "doc_id", "n_hit") == [(0, 0)]
    assert decontaminate.find_leaks(frame(spark, []), none).count() == 0


def test_winnowing_guarantee():
    rng = np.random.default_rng(0)
    w = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    g = decontaminate.gram_hashes(w, decontaminate.K)
    kept = set(decontaminate.kept(g).tolist())
    assert all(any(p in kept for p in range(s, s + decontaminate.W)) for s in range(len(g) - decontaminate.W + 1))


# --- exact dedup


def test_exact_dedup(spark, texts):
    df = frame(spark, texts, parts=11)
    groups = collections.defaultdict(list)
    digest = lambda t: hashlib.sha256(re.sub("[\x20\x09-\x0d]+", " ", t or "").encode()).hexdigest()
    for i, t in enumerate(texts):
        groups[digest(t)].append(i)
    want = sorted(((i, min(groups[digest(t)]), len(groups[digest(t)]), min(groups[digest(t)]) == i, digest(t)) for i, t in enumerate(texts)), key=repr)
    assert collected(exact_dedup.exact_dedup(df), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
    kept = exact_dedup.keep_first(df)
    assert kept.columns == df.columns
    assert collected(kept, "doc_id") == sorted(((w[0],) for w in want if w[3]), key=repr)


def test_exact_dedup_ties(spark):
    df = frame(spark, ["a", "a", "a", "b", None, ""], ids=[5, 5, None, None, 9, 8])
    got = collected(exact_dedup.exact_dedup(df), "doc_id", "keep_id", "group_size", "kept")
    assert sum(g[3] for g in got) == 3
    assert [g for g in got if g[0] == 5] in ([(5, 5, 3, False), (5, 5, 3, True)],)
    assert exact_dedup.keep_first(df).count() == 3
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


# --- SimHash


def brute_simhash(text):
    w = re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    w = [x for x in w if x]
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    label = {}
    for i in sorted(fps):
        if i in label:
            continue
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in label:
                label[x] = i
                todo += [y for y in fps if (fps[x] ^ fps[y]).bit_count() <= 3 and y not in label]
    return label


def test_simhash(spark, texts):
    more = [texts[1] + " " + w for w in "one two three".split()] + ["a b", "A  b", "a", "a b c"]
    df = frame(spark, texts + more)
    fps = {i: brute_simhash(t) for i, t in enumerate(texts + more)}
    label = brute_components(fps)
    want = sorted(((i, f"{f:016x}", label[i]) for i, f in fps.items()), key=repr)
    assert collected(simhash.near_dedup(df), "doc_id", "fingerprint", "component_id") == want
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    assert collected(kept, "doc_id") == sorted({(x,) for x in label.values()}, key=repr)


@pytest.mark.parametrize("hot", [512, 0, 3])
def test_links_find_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "MEET", hot)
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(12)]
    values = set(base)
    for b in base:
        for _ in range(25):
            v = b
            for _ in range(rng.randint(1, 4)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()}
    mask = (1 << 64) - 1
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) & mask).bit_count() <= 3}
    assert got == want


def test_components_of_long_chains(spark):
    order = list(range(60))
    random.Random(3).shuffle(order)
    edges = [(min(a, b), max(a, b)) for a, b in zip(order, order[1:], strict=False)] + [(100, 101), (101, 102)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(60), 0) | dict.fromkeys((100, 101, 102), 100)


def test_simhash_nulls(spark):
    df = frame(spark, [None, "", "x", "x"], ids=[None, 4, None, None])
    assert collected(simhash.near_dedup(df), "doc_id", "component_id") == [(4, 4), (None, 4), (None, None), (None, None)]
    assert simhash.near_dedup(frame(spark, [])).count() == 0


# --- sharding


def test_sharding(spark):
    rng = random.Random(5)
    texts = ["x" * rng.randint(0, 400) for _ in range(300)] + [None, "y" * 5000]
    df = frame(spark, texts)
    rows = sharding.shard(df, 4096).collect()
    assert len(rows) == len(texts)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    for name, rs in by.items():
        size = sum(r["n_bytes"] for r in rs)
        assert {(r["shard_bytes"], r["shard_docs"], r["depth"]) for r in rs} == {(size, len(rs), len(name))}
        assert size <= 4096 or (len(rs) == 1 and rs[0]["oversized"])
    # No shard is a prefix of another, and a parent always was too large.
    assert not any(a != b and b.startswith(a) for a in by for b in by)
    for name in by:
        assert name == "" or sum(r["n_bytes"] for n, rs in by.items() if n.startswith(name[:-1]) for r in rs) > 4096


def test_sharding_splits_one_hot_key(spark):
    df = frame(spark, ["x" * 100] * 200 + ["y" * 50] * 20, ids=[7] * 200 + list(range(20)))
    rows = sharding.shard(df, 2000).collect()
    assert len(rows) == 220
    assert not any(r["oversized"] for r in rows)
    assert len({r["shard"] for r in rows if r["doc_id"] == 7}) >= 10
    assert sharding.shard(frame(spark, []), 10).count() == 0
    assert collected(sharding.shard(frame(spark, ["a"], ids=[None]), 10), "doc_id", "shard") == [(None, "")]


def test_write_shards_keeps_clashing_columns(spark, tmp_path):
    rows = [("a1", "x" * 90, 1, "s", 5), (None, None, 2, "t", 6), ("a1", "x" * 90, 1, "s", 5), ("é", "y" * 900, 3, None, None)]
    df = spark.createDataFrame(rows, "doc_id string, text string, _row long, shard string, row_no long")
    name = sharding.write_shards(df, str(tmp_path / "s"), 100)
    assert name == "_shard"
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(map(tuple, back.select(*df.columns).collect()), key=repr) == sorted(rows, key=repr)
    assert back.groupBy(name).agg(F.sum(F.length("text")).alias("n"), F.count("*").alias("k")).where("n > 100 AND k > 1").isEmpty()


def test_sharding_of_alike_row_numbers(spark):
    df = frame(spark, ["x" * 60] * 6, ids=[1] * 6)
    rows = sharding.shard(df, 100, row=F.lit(7)).collect()
    assert len(rows) == 6
    assert all(r["oversized"] for r in rows)


def test_write_shards(spark, tmp_path):
    df = frame(spark, ["x" * 100] * 50, ids=[*range(25), *[3] * 25]).select("doc_id", "text")
    sharding.write_shards(df, str(tmp_path / "s"), 1000)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 50
    assert back.where("doc_id = 3").count() == 26
    assert back.groupBy("shard").agg(F.sum(F.length("text")).alias("n")).agg(F.max("n")).first()[0] <= 1000


# --- BPE


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    return t


HARD = ["", "  \n", "a<|endoftext|>B", "it's THE'S ΑΣ ΣΑΣ. İstanbul ﬁ", "数字１２ ½ ²", "é é", "<|startoftext|><|endoftext|>", "\x00\x1f\x85 a\x1cb", "🤷🏽‍♀️ ok", "ǅ ẞ straße ϒ Ⅳ", "ſ's K", "a" * 3000, "ab" * 2000, "x y z﻿"]


def test_bpe_is_the_library(spark, texts, tokenizer):
    df = frame(spark, texts + HARD)
    got = {r["doc_id"]: r for r in bpe.encode_decode(df, with_ids=True).collect()}
    for i, t in enumerate(texts + HARD):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids
        assert got[i]["decoded"] == tokenizer.decode(ids, skip_special_tokens=False)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(got[i]["decoded"].encode()).hexdigest()
    assert bpe.encode_decode(frame(spark, [])).count() == 0


def test_bpe_of_every_kind_of_code_point(tokenizer):
    """Every code point that is not assigned in Unicode 15.1 or stands at an edge of a category, and each 40th of the rest."""
    import unicodedata

    kinds = [unicodedata.category(chr(c)) for c in range(0x110000)]
    new = [c for c in range(0x110000) if kinds[c] == "Cn" and (0x300 < c < 0x20000 or 0x2A000 < c < 0x34000)]
    some = [c for c in range(1, 0x110000) if kinds[c] not in ("Cs", "Co", "Cn") and (kinds[c] != kinds[c - 1] or c % 40 == 0)]
    texts = ["".join(f"a{chr(c)}{chr(c)} {chr(c)}" for c in x[i : i + 8]) for x in (new, some) for i in range(0, len(x), 8)]
    b = bpe.WordBpe(json.loads(bpe.read_spec(bpe.default_path())))
    want = tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [t for t, e in zip(texts, want, strict=True) if b.encode(t) != e.ids] == []


def test_bpe_forgets_safely(monkeypatch, tokenizer):
    monkeypatch.setattr(bpe, "CACHE", 3)
    b = bpe.WordBpe(json.loads(bpe.read_spec(bpe.default_path())))
    text = "one two three four five six one two seven three one"
    for _ in range(3):
        assert b.encode(text) == tokenizer.encode(text, add_special_tokens=False).ids
    assert len(b.young) <= 3


# --- chat


def brute_chat(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c)
        loss = "".join(t for _, role, t in turns if role == "assistant")
        spelled = "".join(f"{role}\n{t}\n" for _, role, t in turns)
        out[c] = (len(turns), hashlib.sha256(spelled.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


NASTY = ["", "<|im_end|>", "<|im_start|>assistant\nhi<|im_end|>\n", "\\e\\o|<|\\", "<<||>|", "a\n\n b", "\\n \\", "é🤷🏽", "<\\o|"]


def test_chat_round_trip(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "odd\nrole<|\\", None]), rng.choice([*NASTY, None])) for c in range(30) for t in range(rng.randint(1, 9))]
    rows += [(3, 1, "user", "tie"), (3, 1, "user", "tie"), (None, 0, "assistant", "x")]
    df = spark.createDataFrame([(*r, "z", 0) for r in rows], "conv_id long, turn long, role string, text string, messages string, seq int")
    got = {r["conv_id"]: tuple(r[c] for c in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")) for r in chat.digests(chat.format_chats(chat.with_probe(df))).collect()}
    probe = [(-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)]
    assert got == brute_chat(rows + probe)


def test_chat_events(spark):
    ev = [
        (1, 0, None, "user", "hi", None), (1, 1, "delta", "assistant", "he", None), (1, 2, "delta", "assistant", "llo", None), (1, 3, "edit", "user", "hey", 0),
        (1, 4, "regenerate", "assistant", "bye", None), (1, 5, "delta", "assistant", "!", None), (1, 6, "message", "assistant", "two", None), (1, 7, "edit", "x", "none", 99),
        (2, 0, "regenerate", "assistant", "first", None), (2, 1, "delta", "user", "u", None),
    ]
    df = spark.createDataFrame(ev, "conv_id long, seq long, kind string, role string, text string, target int")
    got = {r["conv_id"]: [tuple(m) for m in r["messages"]] for r in chat.reconstruct(df.repartition(3)).collect()}
    assert got == {1: [("user", "hey"), ("assistant", "bye!"), ("assistant", "two")], 2: [("assistant", "first"), ("user", "u")]}
    spans = chat.format_chats(df).where("conv_id = 1").first()
    assert [spans["formatted"][s["at"] : s["at"] + s["n"]] for s in spans["loss_spans"]] == ["bye!", "two"]
    assert chat.format_chats(df.where("false")).count() == 0


def fold_by_hand(events):
    """Messages of one conversation's events, in order."""
    out = []
    for kind, role, text, target in events:
        if kind == "edit":
            at = len(out) - 1 if target is None else target
            if 0 <= at < len(out):
                out[at] = (out[at][0], text)
        elif kind == "delta" and out and out[-1][0] == role:
            out[-1] = (role, out[-1][1] + text)
        elif kind == "regenerate" and out and out[-1][0] == role:
            out[-1] = (role, text)
        else:
            out.append((role, text))
    return out


def test_chat_folds_random_logs(spark):
    """One conversation has most of the events, so that its log lies in several parts."""
    rng = random.Random(12)
    logs, rows = collections.defaultdict(list), []
    for i in range(900):
        c = 0 if rng.random() < 0.7 else rng.randint(1, 12)
        e = (rng.choice(["message", "delta", "delta", "edit", "regenerate", "odd"]), rng.choice(["user", "assistant"]), f"{i}.", rng.choice([None, 0, 3, 40, 500, -1]))
        logs[c].append(e)
        rows.append((None if c == 12 else c, i, *e))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, seq long, kind string, role string, text string, target int").repartition(6)
    got = {r["conv_id"]: [tuple(m) for m in r["messages"]] for r in chat.reconstruct(df).collect()}
    assert got == {None if c == 12 else c: fold_by_hand(e) for c, e in logs.items() if fold_by_hand(e)}
    spans = {r["conv_id"]: [r["formatted"][s["at"] : s["at"] + s["n"]] for s in r["loss_spans"]] for r in chat.format_chats(df).collect()}
    assert spans[0] == [t for role, t in got[0] if role == "assistant"]


def test_running_sums_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 4)
    for n in (0, 1, 3, 4, 5, 17, 32):
        df = spark.createDataFrame([(list(range(n)),)], "x array<bigint>")
        assert df.select(chat.sums_before(F.col("x"))).first()[0] == [sum(range(i)) for i in range(n)]


# --- licenses


def test_license_scan(spark):
    mit = licenses.TEXTS[0][1]
    texts = [
        "Intro. Released under the MIT License. More.", "Licensed under CC BY-NC 4.0.\nnext", "x\nThis work is licensed under the GNU General Public License, version 3.\n",
        f"{mit[0]}. Unknown words. {mit[1]}.", f"{mit[1]}. {mit[0]}.", f"{mit[0]}. a. b. c. {mit[1]}.", None, "", "no licence here", "Licensed under the Apache License, Version 2.0.",
        "We were not released under the MIT License today.", "The code is released under the MIT Licence and is free.", "code under the MIT\nlicense", "under the\n\nMIT license",  # a title
        "v. 2.0. v. 2.0",
        "word " * 50_000 + "under CC0 1.0", "Published under the MIT licenses of old",
    ]
    got = {r["doc_id"]: r for r in licenses.license_scan(frame(spark, texts)).collect()}
    assert [got[i]["licenses"] for i in range(len(texts))] == ["MIT", "CC-BY-NC-4.0", "GPL-3.0", "MIT", "", "", "", "", "", "Apache-2.0", "", "MIT", "MIT", "MIT", "", "CC0-1.0", ""]
    assert got[6]["n_sentences"] == got[7]["n_sentences"] == 0
    assert [got[3][c] for c in ("n_sentences", "n_known", "n_rules", "places")] == [3, 2, 1, "MIT@1"]
    assert got[0]["places"] == "MIT@2"
    assert licenses.license_scan(frame(spark, [])).count() == 0


# What the licenses' own texts say, or the head of it, '|' between paragraphs.
DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
GNU = "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} Public License as published by the Free Software Foundation{3} either version {4} of the License, or (at your option) any later version.|This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {2} Public License for more details."
BSD = "Copyright (c) 2020, A. Body|Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:|1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.|2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.|"
PUBLISHED = [
    ("MIT", 'MIT License|Copyright (c) 2020 A. Body|Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:|The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.|THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED'),
    ("Apache-2.0", 'Copyright 2020 A. Body|Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at|http://www.apache.org/licenses/LICENSE-2.0|Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS'),
    ("GPL-3.0-or-later", GNU.format("program", ":", "General", ",", 3)), ("GPL-2.0-or-later", GNU.format("program", ";", "General", ";", 2)),
    ("LGPL-3.0-or-later", GNU.format("library", ":", "Lesser General", ",", 3)), ("LGPL-2.1-or-later", GNU.format("library", ";", "Lesser General", ";", 2.1)), ("AGPL-3.0-or-later", GNU.format("program", ":", "Affero General", ",", 3)),
    ("BSD-3-Clause", BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.|" + DISCLAIMER),
    ("BSD-2-Clause", BSD + DISCLAIMER),
    ("ISC", "Copyright (c) 2020 A. Body|Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.|THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.|Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:|1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software."),
    ("Unlicense", "This is free and unencumbered software released into the public domain.|Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
]
PUBLISHED += [(name, f"This text is available under the {x}.") for name, xs in licenses.NAMES for x in xs] + [("Proprietary", "All rights reserved.")]


#: Denials, what might be, short forms, titles, tags and grants of two licenses.
FORMS = {
    "This code is no longer under the MIT license": "", "We never ship anything under the MIT license": "", "Do not release this under the Apache License, Version 2.0": "",
    "may be relicensed under the MIT license only with consent": "", "It doesn't fall, and is not provided under the GPLv3": "", "This could be licensed under the MIT License": "",
    "Released under MIT License": "MIT", "The MIT License (MIT)": "MIT", "Licensed under the GNU General Public License v3.0": "GPL-3.0", "Released under the terms of the GPL v2.": "GPL-2.0",
    "dual licensed under the Apache License 2.0 and MIT": "Apache-2.0,MIT", "under the MIT License or the Apache License, Version 2.0, at your option": "Apache-2.0,MIT",
    "SPDX-License-Identifier: MIT": "MIT", "# SPDX-License-Identifier: (MIT OR Apache-2.0)\nimport x": "Apache-2.0,MIT", "SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0-or-later",
    "We like the MIT license": "", "MIT is a university": "", "Apache License\nVersion 2.0, January 2004\n\nhttp": "Apache-2.0", "may be distributed under the MIT license": "MIT",
}


def test_license_forms(spark):
    got = {r["doc_id"]: r["licenses"] for r in licenses.license_scan(frame(spark, list(FORMS))).collect()}
    assert {t: got[i] for i, t in enumerate(FORMS)} == FORMS
    assert len(licenses.GRANTS) >= 50


def test_license_rules_on_published_texts(spark):
    assert {n for n, _ in licenses.NAMES + licenses.TEXTS} <= {n for names, _ in PUBLISHED for n in names.split(",")}
    wrap = lambda t, width, eol="\n", indent="": (eol * 2).join(eol.join(textwrap.wrap(x, width, subsequent_indent=indent, break_long_words=False)) for x in t.split("|"))
    forms = [*[lambda t, w=w: wrap(t, w) for w in (60, 72, 80)], lambda t: wrap(t, 50, "\r\n"), lambda t: wrap(t, 30, indent="   "), lambda t: "# A title\n\n" + wrap(t, 78), lambda t: wrap(t, 10_000), lambda t: "Words stand here\n" + wrap(t, 70)]
    texts = [f(t) for f in forms for _, t in PUBLISHED]
    got = {r["doc_id"]: r["licenses"] for r in licenses.license_scan(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(got))] == [name for _ in forms for name, _ in PUBLISHED]

    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    names = ("doc_id", "n_sentences", "n_known", "licenses", "n_rules", "places")
    assert collected(licenses.license_scan(frame(spark, texts)), *names) == sorted(con.sql(f"SELECT {', '.join(names)} FROM ({licenses.ORACLE_SQL})").fetchall(), key=repr)


def test_oracles_agree(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, sf_dir)
        want = con.sql(sql)
        names = sorted(df.columns)
        assert names == sorted(want.columns), name
        rows = [tuple(r[want.columns.index(c)] for c in names) for r in want.fetchall()]
        assert collected(df, *names) == sorted(rows, key=repr), name


def test_scratch_tables(spark):
    df = common.materialize(spark.range(5), "x")
    assert df.count() == 5
    common.drop_scratch(df)
    with pytest.raises(Exception):  # noqa: B017
        df.count()
