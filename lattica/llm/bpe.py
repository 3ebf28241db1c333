"""BPE encoding and decoding with a vocabulary file in the ``tokenizers`` JSON format.

Each word is a doubly linked list of symbols with a priority queue of merge ranks; entries whose symbols have changed
since they were queued are stale and skipped. Words repeat, so each worker keeps the result of recent words.
Decoding concatenates the vocabulary's strings.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property, lru_cache
from struct import pack

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import arrow_map

#: Words in each of the two generations of a worker's table of recent words. A full young generation becomes the old
#: one; a word found there is young again, so frequent words stay. Speed only.
CACHE = 1 << 17


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves, others follow from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


def for_ascii(pattern: str) -> str:
    """The pattern with \\p{L}, \\p{N} and \\s, all inside sets, spelled out for lower-case ASCII text."""
    return pattern.replace(r"\s", r" \t-\r").replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9")


# Code points that Unicode 16 added as letters and as numbers.
ADDED = {
    "L": [
        (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
        (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
        (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
    ],
    "N": [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)],
}
# Lower cases that Unicode 16 and 17 added.
ADDED_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
ADDED_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
SOME_ADDED = re.compile(f"[{''.join(map(chr, ADDED_LOWER))}]").search
#: Below this code point all versions of Unicode agree on what letters, numbers and lower cases are.
AGREED = 0x558
SOME_LATER = re.compile(f"[{chr(AGREED)}-{chr(0x10FFFF)}]").search


def ranges(flags: Iterable[bool]) -> list[tuple[int, int]]:
    """First and last places of the runs that are true."""
    edges, inside = [], False
    for c, now in enumerate([*flags, False]):
        if now != inside:
            edges.append(c)
            inside = now
    return [(a, b - 1) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def as_set(found: Iterable[tuple[int, int]]) -> str:
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in found)


@lru_cache(maxsize=2)
def code_points(major: str) -> list[bool]:
    """Whether each code point is of a general category in Unicode 16, which the library has: by Python's tables (15.1 since 3.13) and what was added since."""
    flags = [unicodedata.category(chr(c))[0] == major for c in range(0x110000)]
    for a, b in ADDED[major]:
        flags[a : b + 1] = [True] * (b - a + 1)
    return flags


@lru_cache(maxsize=1)
def disputed() -> re.Pattern:
    """Code points that ``regex``, whose tables may be later ones, takes for other kinds than Unicode 16 does."""
    every = "".join(map(chr, range(0x110000)))
    odd = [False] * 0x110000
    for major in ADDED:
        theirs = [False] * 0x110000
        for m in regex.finditer(rf"\p{{{major}}}+", every):
            theirs[m.start() : m.end()] = [True] * (m.end() - m.start())
        odd = [o or x != y for o, x, y in zip(odd, code_points(major), theirs, strict=True)]
    return re.compile(f"[{as_set(ranges(odd))}]" if any(odd) else r"(?!)")


def for_unicode(pattern: str) -> str:
    """The pattern with \\p{L} and \\p{N}, all inside sets, spelled out."""
    return pattern.replace(r"\p{L}", as_set(ranges(code_points("L")))).replace(r"\p{N}", as_set(ranges(code_points("N"))))


class WordBpe:
    """Encoder and decoder of a word-end BPE file: NFC, white space to one space, lower case; words by the file's pattern; byte-level symbols."""

    def __init__(self, spec: dict) -> None:
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {self.vocab[a] << 20 | self.vocab[b]: i for i, (a, b) in enumerate(pairs)}
        self.merged = [self.vocab[a + b] for a, b in pairs]
        self.of_byte = [self.vocab[c] for c in byte_alphabet()]
        self.of_last = [self.vocab[c + self.suffix] for c in byte_alphabet()]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        by_id = {i: s for s, i in (self.vocab | added).items()}
        self.strings = [by_id.get(i, "") for i in range(max(by_id) + 1)]
        self.added = {s: pack("<I", i) for s, i in added.items()}
        self.at_added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = split["pattern"]["Regex"]
        self.pattern = pattern
        self.words = regex.compile(pattern).findall
        self.ascii_words = re.compile(for_ascii(pattern)).findall
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @cached_property
    def exact_words(self) -> Callable[[str], list[str]]:
        """As ``words``, by ranges of code points; slower, for texts that hold disputed ones."""
        return regex.compile(for_unicode(self.pattern)).findall

    @classmethod
    def from_text(cls, text: str) -> WordBpe:
        return cls(json.loads(text))

    def merge(self, word: str) -> list[int]:
        """Token ids of one word."""
        data = word.encode()
        symbols = [self.of_byte[b] for b in data]
        symbols[-1] = self.of_last[data[-1]]
        n = len(symbols)
        if n == 1:
            return symbols
        rank_of, merged = self.ranks.get, self.merged
        # An entry is a rank and a place; it is stale if the pair at its place has another rank by now.
        queue = [r << 32 | i for i in range(n - 1) if (r := rank_of(symbols[i] << 20 | symbols[i + 1], -1)) >= 0]
        if not queue:
            return symbols
        heapq.heapify(queue)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        while queue:
            entry = heapq.heappop(queue)
            rank, i = entry >> 32, entry & 0xFFFFFFFF
            j = after[i]
            if j < 0 or rank_of(symbols[i] << 20 | symbols[j]) != rank:
                continue
            new = symbols[i] = merged[rank]
            symbols[j] = -1
            k = after[i] = after[j]
            after[j] = -1
            if k >= 0:
                before[k] = i
                if (r := rank_of(new << 20 | symbols[k], -1)) >= 0:
                    heapq.heappush(queue, r << 32 | i)
            k = before[i]
            if k >= 0 and (r := rank_of(symbols[k] << 20 | new, -1)) >= 0:
                heapq.heappush(queue, r << 32 | k)
        return [s for s in symbols if s >= 0]

    def packed(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers, one after the other."""
        out: list[bytes] = []
        at = 0
        if self.at_added:
            for m in self.at_added.finditer(text):
                self._plain(text[at : m.start()], out)
                out.append(self.added[m[0]])
                at = m.end()
        self._plain(text[at:] if at else text, out)
        return b"".join(out)

    def _plain(self, text: str, out: list[bytes]) -> None:
        if not text:
            return
        # White space is in no word, so how much of it there is makes no difference.
        if text.isascii():
            words = self.ascii_words(text.lower())
        else:
            text = unicodedata.normalize("NFC", text)
            # Lower case goes by code point: no rule that looks at neighbours (final sigma) may apply.
            low = text.lower() if "Σ" not in text else "".join(map(str.lower, text))
            if SOME_LATER(low):
                low = low.translate(ADDED_LOWER) if SOME_ADDED(low) else low
                words = self.exact_words(low) if disputed().search(low) else self.words(low)
            else:
                words = self.words(low)
        recent = self.young.get
        for w in words:
            got = recent(w)
            if got is None:
                got = self._fetch(w)
                recent = self.young.get
            out.append(got)

    def _fetch(self, word: str) -> bytes:
        """Packed ids of a word that is not young."""
        got = self.old.get(word)
        if got is None:
            ids = self.merge(word)
            got = pack(f"<{len(ids)}I", *ids)
        if len(word) <= 64:
            if len(self.young) >= CACHE:
                self.old, self.young = self.young, {}
            self.young[word] = got
        return got

    def encode(self, text: str | None) -> list[int]:
        return memoryview(self.packed(text or "")).cast("I").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The vocabulary's strings, joined as the file's decoder says: this one has none, so by single spaces."""
        return " ".join(map(self.strings.__getitem__, ids))


@lru_cache(maxsize=2)
def _encoder(spec: str) -> WordBpe:
    return WordBpe.from_text(spec)


def read_spec(path: str) -> str:
    """The vocabulary file's text. The driver reads it; it is a few MB, fixed with the tokenizer."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def default_path() -> str:
    """Where the public tokenizers' package keeps the file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, on request, ids and decoded: one row per input row.

    Null text counts as empty: no token, the empty string. No exchange; memory is that of one slice of rows. Other columns are ignored.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path or default_path()))
    more = ", ids array<int>, decoded string" if with_ids else ""

    def run(batch: pa.RecordBatch) -> pa.Table:
        bpe = _encoder(spec.value)
        n, ids_hash, text_hash, all_ids, texts = [], [], [], [], []
        for text in _strings(batch.column(1)):
            packed = bpe.packed(text)
            ids = memoryview(packed).cast("I")
            decoded = bpe.decode(ids)
            n.append(len(ids))
            ids_hash.append(hashlib.sha256(packed).hexdigest())
            text_hash.append(hashlib.sha256(decoded.encode()).hexdigest())
            if with_ids:
                all_ids.append(ids.tolist())
                texts.append(decoded)
        columns = {"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_hash, pa.string()), "decoded_sha256": pa.array(text_hash, pa.string())}
        if with_ids:
            columns |= {"ids": pa.array(all_ids, pa.list_(pa.int32())), "decoded": pa.array(texts, pa.string())}
        return pa.table(columns)

    id_type = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")


def _strings(column: pa.Array) -> Iterator[str]:
    for x in column:
        yield x.as_py() or ""
