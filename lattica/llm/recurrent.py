"""A bidirectional gated recurrent network with attention pooling, in numpy.

Each word enters as the sum of a word embedding (hashed) and of the embeddings of its characters: of its 4-grams (hashed,
with the word's end) and of its beginning. A window of words is read in both directions; attention weighs the states, and one logit comes out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from lattica.llm.words import LOWER, spans, word_hashes

WORD_BITS, GRAM_BITS = 15, 14
IS_WORD = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
#: Bytes of a word's beginning that are hashed together.
STEM = 6
D, H, A = 16, 8, 8


@dataclass
class Words:
    """Words of a block of texts: hashed word, hashed grams of all words one after the other, and first word of each text."""

    word: np.ndarray
    gram: np.ndarray
    at: np.ndarray
    bound: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Words:
        buf = np.frombuffer(b" ".join([b"", *texts, b" "]).translate(LOWER), np.uint8)
        starts, ends = spans(buf, IS_WORD)
        b = np.where(IS_WORD[buf], buf, 0).astype(np.uint32)
        i = np.flatnonzero(b)
        m = np.uint32(257)
        h = ((b[i - 1] * m + b[i]) * m + b[i + 1]) * m + np.where(b[i + 1] > 0, b[np.minimum(i + 2, len(b) - 1)], np.uint32(0))
        # The first place of a word has the hash of its beginning instead, by which forms of one stem are alike.
        first = np.flatnonzero(b[i - 1] == 0)
        stem, alive = np.full(len(first), 7, np.uint32), np.ones(len(first), bool)
        for step in range(STEM):
            c = b[np.minimum(i[first] + step, len(b) - 1)]
            alive &= c > 0
            stem = np.where(alive, stem * m + c, stem)
        h[first] = stem
        gram = (h * np.uint32(2654435761)) >> np.uint32(32 - GRAM_BITS)
        at = np.concatenate([[0], np.cumsum(ends - starts)])
        word = (word_hashes(buf, starts, ends) >> np.uint64(64 - WORD_BITS)).astype(np.int32)
        bound = np.concatenate([[0], np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))]) if texts else np.zeros(1, np.int64)
        return cls(word, gram.astype(np.int32), at, bound)


    def part(self, a: int, b: int) -> Words:
        """The words of texts a to b."""
        lo, hi = int(self.bound[a]), int(self.bound[b])
        g = int(self.at[lo])
        return Words(self.word[lo:hi], self.gram[g : int(self.at[hi])], self.at[lo : hi + 1] - g, self.bound[a : b + 1] - lo)

    def parts(self, words: int) -> list[tuple[int, int]]:
        """Ranges of texts of about so many words; a longer text is a range of its own."""
        out, a, n = [], 0, len(self.bound) - 1
        while a < n:
            b = max(a + 1, int(np.searchsorted(self.bound, self.bound[a] + words, "right")) - 1)
            out.append((a, b))
            a = b
        return out

    @classmethod
    def of_many(cls, texts: list[bytes], size: int = 1 << 18) -> Words:
        """As ``of``, in blocks of about ``size`` bytes, so that only the result grows with the texts."""
        done, a = [], 0
        while a < len(texts):
            b, held = a, 0
            while b < len(texts) and (b == a or held + len(texts[b]) <= size):
                held += len(texts[b])
                b += 1
            done.append(cls.of(texts[a:b]))
            a = b
        if not done:
            return cls.of([])
        n_words, n_grams = np.cumsum([0, *(len(w.word) for w in done)]), np.cumsum([0, *(len(w.gram) for w in done)])
        return cls(
            np.concatenate([w.word for w in done]), np.concatenate([w.gram for w in done]),
            np.concatenate([[0], *(w.at[1:] + n for w, n in zip(done, n_grams, strict=False))]), np.concatenate([[0], *(w.bound[1:] + n for w, n in zip(done, n_words, strict=False))]),
        )


def windows(n: int, size: int, stride: int) -> np.ndarray:
    """First words of all overlapping windows of n words; the last one ends with the text."""
    if n <= size:
        return np.zeros(min(n, 1), np.int64)
    first = np.arange(0, n - size + 1, stride)
    return first if first[-1] == n - size else np.append(first, n - size)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        make = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.p: dict[str, np.ndarray] = {"Ew": make(1 << WORD_BITS, D, scale=0.01), "Ec": make(1 << GRAM_BITS, D, scale=0.01)}
        for d in "fb":
            self.p |= {f"W{d}": make(D, 3 * H, scale=0.4), f"U{d}": make(H, 3 * H, scale=0.3), f"b{d}": np.zeros(3 * H, np.float32)}
        self.p |= {"Wa": make(2 * H, A, scale=0.4), "ba": np.zeros(A, np.float32), "va": make(A, scale=0.4), "wo": make(2 * H, scale=0.3), "bo": np.zeros(1, np.float32)}

    def inputs(self, w: Words) -> np.ndarray:
        if not len(w.word):
            return np.zeros((0, D), np.float32)
        return self.p["Ew"][w.word] + np.add.reduceat(self.p["Ec"][w.gram], w.at[:-1], axis=0)

    def logits(self, x: np.ndarray, first: np.ndarray, length: np.ndarray, size: int, keep: dict | None = None) -> np.ndarray:
        """Logit of each window x[first : first + length], length <= size. ``keep`` gets what the gradient needs."""
        p, n = self.p, len(first)
        padded = bool((length < size).any())
        last = len(x) - 1
        states = {}
        for d in "fb":
            pre = x @ p[f"W{d}"] + p[f"b{d}"]
            h = np.zeros((n, H), np.float32)
            out = np.empty((size, n, H), np.float32)
            steps = []
            for t in range(size) if d == "f" else range(size - 1, -1, -1):
                a = pre[np.minimum(first + t, last)]
                g = h @ p[f"U{d}"]
                zr = 1 / (1 + np.exp(-np.clip(a[:, : 2 * H] + g[:, : 2 * H], -30, 30)))
                z, r = zr[:, :H], zr[:, H:]
                c = np.tanh(a[:, 2 * H :] + r * g[:, 2 * H :])
                new = c + z * (h - c)
                if padded:
                    new *= (t < length)[:, None]
                if keep is not None:
                    steps.append((t, h, z, r, c, g[:, 2 * H :]))
                h = out[t] = new
            states[d] = out
            if keep is not None:
                keep[d] = steps
        both = np.concatenate([states["f"], states["b"]], axis=2)
        u = np.tanh(both @ p["Wa"] + p["ba"])
        e = np.exp(np.clip(u @ p["va"], -30, 30))
        if padded:
            e *= np.arange(size)[:, None] < length
        w = e / e.sum(axis=0)
        pooled = np.einsum("tn,tnk->nk", w, both)
        if keep is not None:
            keep |= {"both": both, "u": u, "w": w, "pooled": pooled}
        return pooled @ p["wo"] + p["bo"][0]

    def gradient(self, x: np.ndarray, first: np.ndarray, length: np.ndarray, size: int, k: dict, d_logit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters but embeddings, and of x. No two windows may share a word of x."""
        p, n = self.p, len(first)
        g = {"wo": k["pooled"].T @ d_logit, "bo": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * p["wo"]
        d_both = k["w"][:, :, None] * d_pooled
        d_w = np.einsum("tnk,nk->tn", k["both"], d_pooled)
        d_e = k["w"] * (d_w - (k["w"] * d_w).sum(axis=0))
        d_u = d_e[:, :, None] * p["va"] * (1 - k["u"] ** 2)
        g |= {"va": np.einsum("tn,tna->a", d_e, k["u"]), "ba": d_u.sum(axis=(0, 1)), "Wa": np.einsum("tnk,tna->ka", k["both"], d_u)}
        d_both += d_u @ p["Wa"].T
        d_x = np.zeros_like(x)
        for d, part in (("f", slice(0, H)), ("b", slice(H, 2 * H))):
            u, dh = p[f"U{d}"], np.zeros((n, H), np.float32)
            d_pre, d_u_all = np.zeros((len(x), 3 * H), np.float32), np.zeros_like(u)
            for t, h, z, r, c, q in reversed(k[d]):
                dh = (dh + d_both[t][:, part]) * (t < length)[:, None]
                dc = dh * (1 - z) * (1 - c**2)
                dz = dh * (h - c) * z * (1 - z)
                dr = dc * q * r * (1 - r)
                to_gates = np.concatenate([dz, dr, dc * r], axis=1)
                there = t < length  # windows don't share words here, so each row gets one gradient
                d_pre[first[there] + t] = np.concatenate([dz, dr, dc], axis=1)[there]
                d_u_all += h.T @ to_gates
                dh = dh * z + to_gates @ u.T
            g |= {f"U{d}": d_u_all, f"W{d}": x.T @ d_pre, f"b{d}": d_pre.sum(axis=0)}
            d_x += d_pre @ p[f"W{d}"].T
        return g, d_x


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float) -> None:
        self.p, self.rate, self.n = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray], decay: float = 1e-5) -> None:
        self.n += 1
        rate = self.rate * np.sqrt(1 - 0.999**self.n) / (1 - 0.9**self.n)
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.p[k] -= (rate * self.m[k] / (np.sqrt(self.v[k]) + 1e-8) + self.rate * decay * self.p[k]).astype(np.float32)
