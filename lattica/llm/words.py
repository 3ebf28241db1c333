"""Word boundaries and 64-bit hashes of byte ranges, for whole blocks of text at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes hashed at once; a longer block is cut where no word is.
CHUNK = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=4)
def byte_values(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * BASE + np.uint64(seed))


@lru_cache(maxsize=4)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i up to n."""
    def of(b: int) -> np.ndarray:
        x = np.full(n + 1, b, np.uint64)
        x[0] = 1
        return np.cumprod(x, dtype=np.uint64)

    return of(int(BASE)), of(pow(int(BASE), -1, 1 << 64))


def range_hashes(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray, seed: int = 1) -> np.ndarray:
    """Hash of buf[lo:hi] for each pair; equal bytes have equal hashes wherever they are. The block is at most a few MB."""
    up, down = powers(max(CHUNK, 1 << int(len(buf)).bit_length()))
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(byte_values(seed)[buf] * up[: len(buf)], out=sums[1:])
    return mix((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64))


def spans(buf: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes."""
    flags = np.zeros(len(buf) + 2, np.int8)
    flags[1:-1] = is_word[buf]
    edges = np.flatnonzero(np.diff(flags))
    return edges[::2], edges[1::2]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """Hash of each word, chunk by chunk; a word longer than a chunk is a chunk of its own."""
    if len(buf) <= CHUNK:
        return range_hashes(buf, starts, ends, seed)
    out, at = [np.empty(0, np.uint64)], 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK, "right")))
        base = starts[at]
        out.append(range_hashes(buf[base : ends[to - 1]], starts[at:to] - base, ends[at:to] - base, seed))
        at = to
    return np.concatenate(out)


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n neighbours; len(x) - n + 1 values."""
    have = 1
    while have * 2 <= n:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (n - have)], x[n - have :]) if n > have else x
