"""Toxicity scores: the recurrent network of ``recurrent`` over all overlapping windows of every text.

Training takes a sample of labelled rows, at most ``SAMPLE`` texts of each label, smallest hashes of their ids first.
Labels are given for texts, not windows: of a toxic text, the windows count that words and character grams common in
toxic and rare in clean texts point to at first, and later those that the network itself scores highest. Parts of the
sample, each unseen by the network that scores it, calibrate the largest logit of a text into a probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import arrow_filter, arrow_map, utf8
from lattica.llm.recurrent import GRAM_BITS, IS_WORD, WORD_BITS, Adam, Network, Words, sigmoid, windows
from lattica.llm.samples import SAMPLE_BYTES, labelled_sample
from lattica.llm.words import LOWER, spans

SIZE, STRIDE = 32, 16
SAMPLE = 1500
EPOCHS, LEAST_STEPS, BATCH, RATE = 6, 200, 256, 0.01
#: Parts of the sample, each of which calibrates a network that has not seen it.
FOLDS = 3
#: A toxic text that is missed weighs as much as so many clean ones that are rejected.
COST = 2.5
#: Windows of a toxic text that count as toxic at most, and windows of clean texts in an epoch.
POSITIVE, NEGATIVE = 4, 9000
THRESHOLD = 0.7
#: Bytes of text, about, that are scored at once.
BLOCK = 1 << 18
#: Windows of a text that are scored at once; the grid of windows is that of the whole text.
GRID = 4096


def parts(text: bytes) -> list[bytes]:
    """The text in parts of whole words whose windows, taken together, are just those of the whole text."""
    step = GRID * STRIDE
    if len(text) < 2 * (step + SIZE):  # it can't have more words than the first part holds
        return [text]
    starts, ends = spans(np.frombuffer(text.translate(LOWER), np.uint8), IS_WORD)
    n, out, a = len(starts), [], 0
    while n - a > step + SIZE - STRIDE and a + step + SIZE <= n:
        out.append(text[starts[a] : ends[a + step - STRIDE + SIZE - 1]])
        a += step
    return [*out, text[starts[a] :] if n else text]


def all_windows(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and length of each window."""
    sizes = np.diff(words.bound)
    first = [windows(int(n), SIZE, STRIDE) for n in sizes]
    text = np.repeat(np.arange(len(sizes)), [len(f) for f in first])
    at = np.concatenate([f + b for f, b in zip(first, words.bound, strict=False)]) if len(text) else np.zeros(0, np.int64)
    return text, at, np.minimum(sizes[text], SIZE)


class Model:
    """The network, and the calibration of a text's signs: weights of its largest logit, of the largest one apart from there, and of its length."""

    def __init__(self, net: Network) -> None:
        self.net, self.weights, self.shift, self.alone = net, np.array([1.0, 0.0, 0.0]), 0.0, 0.0
        self.longest = 0.0

    def window_logits(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first word and logit of each window."""
        done = [self._logits(words.part(a, b), a, int(words.bound[a])) for a, b in words.parts(1 << 15)]
        return tuple(np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))

    def _logits(self, words: Words, text_base: int, word_base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        text, at, length = all_windows(words)
        if not len(at):
            return text, at, np.zeros(0, np.float32)
        x = self.net.inputs(words)
        logits = np.concatenate([self.net.logits(x, at[i : i + 4096], length[i : i + 4096], SIZE) for i in range(0, len(at), 4096)])
        return text + text_base, at + word_base, logits

    def signs(self, texts: list[bytes]) -> np.ndarray:
        """Of each text the largest window logit, the largest of windows that share no word with that one, and the logarithm of the number of windows; -inf without words, and nan without a second window."""
        cut = [parts(t) for t in texts]
        of = np.repeat(np.arange(len(texts)), [len(c) for c in cut])
        found: list[list[np.ndarray]] = [[] for _ in texts]
        block: list[bytes] = []
        owner: list[int] = []

        def flush() -> None:
            text, _, logits = self.window_logits(Words.of(block))
            for o, own in zip(owner, np.split(logits, np.searchsorted(text, np.arange(1, len(block)))), strict=True):
                found[o].append(own)

        held = 0
        for o, piece in zip(of.tolist(), (p for c in cut for p in c), strict=True):
            if held and held + len(piece) > BLOCK:
                flush()
                block, owner, held = [], [], 0
            block.append(piece)
            owner.append(o)
            held += len(piece)
        if block:
            flush()
        out = np.full((len(texts), 3), -np.inf)
        for i, logits in enumerate(found):
            own = np.concatenate(logits) if logits else np.zeros(0)
            if len(own):
                at = int(np.argmax(own))
                apart = np.concatenate([own[: max(0, at - SIZE // STRIDE + 1)], own[at + SIZE // STRIDE :]])
                out[i] = own[at], apart.max() if len(apart) else np.nan, np.log(len(own))
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        x = self.signs(texts)
        some = np.isfinite(x[:, 0])
        return np.where(some, sigmoid(self.told(np.where(some[:, None], x, 0)) @ self.weights + self.shift), 0.0)

    def told(self, x: np.ndarray) -> np.ndarray:
        """The signs without gaps; a length beyond what most of the sample's texts have counts as that, so that a few toxic words in a very long text weigh as much."""
        x = np.where(np.isnan(x), self.alone, x)
        return np.column_stack([x[:, :2], np.minimum(x[:, 2], self.longest)])


def calibrate(x: np.ndarray, y: np.ndarray, prior: float = 0.02, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Weights and shift of a logistic fit with soft targets; Newton steps with a small ridge.

    Some texts are marked without a sign of it in them. At first these are those whose first sign is below the middle of
    both labels' medians; each round then weighs how likely a marked text is such a one, given its signs and the rate of them.
    """
    mean, scale = x.mean(axis=0), np.maximum(1e-6, x.std(axis=0))
    z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], axis=1)
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    middle = (np.median(x[y == 1, 0]) + np.median(x[y == 0, 0])) / 2 if n1 and n0 else -np.inf
    w, t = np.zeros(z.shape[1]), np.where((y == 1) & (x[:, 0] < middle), 1 / (n0 + 2), target)
    for _ in range(rounds):
        for _ in range(8):
            q = sigmoid(z @ w)
            hess = (z * (q * (1 - q))[:, None]).T @ z + prior * np.eye(len(w))
            w -= np.linalg.solve(hess, z.T @ (q - t) + prior * w)
        q = sigmoid(z @ w)
        stray = (y == 1) * (1 - t / target)
        rate = (stray.sum() + 0.01 * n1) / len(y)
        t = np.where(y == 1, target * q / (q + rate * (1 - q)), target)
    weights = w[:-1] / scale
    weights = np.clip(weights, [0.1, 0.0, -1.0], [np.inf, np.inf, 0.0])
    # The shift is fitted again, as weights may have been bounded.
    shift = float(w[-1] - weights @ mean)
    for _ in range(20):
        q = sigmoid(x @ weights + shift)
        shift -= float((q - t).sum() / max(1e-6, (q * (1 - q)).sum()))
    return weights, float(np.clip(shift, -60, 60) + np.log(COST))


def _log_odds(words: Words, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of each hashed word and gram to occur in a toxic text; a part of the texts at a time."""
    n = np.maximum(1, np.bincount(y, minlength=2)[:2])
    counts = [np.zeros((2, 1 << bits)) for bits in (WORD_BITS, GRAM_BITS)]
    for a, b in words.parts(1 << 16):
        own = words.part(a, b)
        text = np.repeat(np.arange(a, b), np.diff(own.bound))
        for hashed, of, count in ((own.word, text, counts[0]), (own.gram, np.repeat(text, np.diff(own.at)), counts[1])):
            once = np.unique(of.astype(np.int64) * count.shape[1] + hashed)
            np.add.at(count, (y[once // count.shape[1]], once % count.shape[1]), 1)
    odds = [np.log((c[1] + 0.5) / (n[1] + 1)) - np.log((c[0] + 0.5) / (n[0] + 1)) for c in counts]
    return odds[0].astype(np.float32), odds[1].astype(np.float32)


def train(texts: list[bytes], y: np.ndarray, seed: int = 7, epochs: int = EPOCHS, folds: int = FOLDS) -> Model:
    """A model of labelled texts. Without both labels it scores all texts alike.

    A network is trained on all folds but one, for each fold; what each says of its own fold sets the calibration, so
    that it rests on all texts and not on the seed or the choice of a small part. The first network then learns the rest.
    """
    model = Model(Network(seed))
    rng = np.random.default_rng(seed)
    if len(set(y.tolist())) < 2:
        model.net.p["wo"][:] = 0
        return model
    # Both labels are spread evenly over the folds; a label of one text is in all trainings.
    fold = np.full(len(y), -1)
    for label in (0, 1):
        own = rng.permutation(np.flatnonzero(y == label))
        if len(own) > 1:
            fold[own] = np.arange(len(own)) % folds
    signs = np.full((len(y), 3), -np.inf)
    opt = None
    for f in range(folds):
        one = model if f == 0 else Model(Network(seed + f))
        learner = Adam(one.net.p, RATE)
        opt = opt or learner
        learn, tune = np.flatnonzero(fold != f), np.flatnonzero((fold == f) | (fold < 0))
        if not _fit(one, learner, [texts[i] for i in learn], y[learn], rng, epochs, LEAST_STEPS):
            return model
        signs[tune] = one.signs([texts[i] for i in tune])
    fine = np.isfinite(signs[:, 0])
    apart = signs[fine & np.isfinite(signs[:, 1]), 1]
    model.alone = float(np.median(apart)) if len(apart) else 0.0
    model.longest = float(np.quantile(signs[fine, 2], 0.9))
    model.weights, model.shift = calibrate(model.told(signs[fine]), y[fine])
    opt.rate = RATE / 2
    _fit(model, opt, texts, y, rng, 1, LEAST_STEPS // 2, warm=True)
    return model


def _fit(model: Model, opt: Adam, texts: list[bytes], y: np.ndarray, rng: np.random.Generator, epochs: int, least_steps: int, warm: bool = False) -> bool:
    """Trains the network on all windows of the texts; False if they have no words. A network that is ``warm`` chooses windows by itself from the start."""
    words = Words.of_many(texts)
    if not len(words.word):
        return False
    sizes = np.diff(words.bound)
    text, at, length = all_windows(words)
    if warm:
        value = model.window_logits(words)[2].astype(np.float64)
    else:
        word_odds, gram_odds = _log_odds(words, y)
        sign = np.concatenate([word_odds[p.word] + np.maximum.reduceat(gram_odds[p.gram], p.at[:-1]) for p in (words.part(a, b) for a, b in words.parts(1 << 16)) if len(p.word)])
        value = np.array([sign[a : a + n].max() for a, n in zip(at.tolist(), length.tolist(), strict=True)])
    negative = np.flatnonzero(y[text] == 0)
    hard = negative[:0]
    steps = epoch = 0
    while epoch < epochs or steps < least_steps:
        order = np.lexsort((-value, text))
        rank = np.arange(len(order)) - np.searchsorted(text[order], text[order])
        best = np.full(len(sizes), -np.inf)
        np.maximum.at(best, text, value)
        close = value[order] >= best[text[order]] - (1.0 if epoch < 2 and not warm else 3.0)
        positive = order[(y[text[order]] == 1) & (rank < POSITIVE) & close]
        some = rng.choice(negative, min(NEGATIVE, len(negative)), replace=False)
        chosen = np.concatenate([positive, some, hard])
        weight = np.where(y[text[chosen]] == 1, len(chosen) / (2 * max(1, len(positive))), len(chosen) / (2 * max(1, len(chosen) - len(positive))))
        mixed = rng.permutation(len(chosen))
        for i in range(0, len(mixed), BATCH):
            part = mixed[i : i + BATCH]
            _learn(model.net, opt, words, at[chosen[part]], length[chosen[part]], y[text[chosen[part]]], weight[part], rng)
            steps += 1
        epoch += 1
        if epoch >= 2 or warm:
            value = model.window_logits(words)[2].astype(np.float64)
            hard = negative[np.argsort(-value[negative])[: NEGATIVE // 6]]
    return True


def _learn(net: Network, opt: Adam, words: Words, at: np.ndarray, length: np.ndarray, y: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> None:
    """One step on a batch of windows, whose words are taken out of the block."""
    n = int(length.sum())
    index = np.repeat(at - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(n)
    grams = np.diff(words.at)[index]
    gram_at = np.concatenate([[0], np.cumsum(grams)])
    gram_index = np.repeat(words.at[index] - gram_at[:-1], grams) + np.arange(int(gram_at[-1]))
    own = Words(words.word[index], words.gram[gram_index], gram_at, np.zeros(1, np.int64))
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    # Half of the words are known by their characters alone, so that unseen forms of a stem are learned too.
    hidden = rng.random(n) < 0.5
    x, keep = net.inputs(own), {}
    x[hidden] -= net.p["Ew"][own.word[hidden]]
    logit = net.logits(x, first, length, SIZE, keep)
    d_logit = ((sigmoid(logit) - y) * weight / len(y)).astype(np.float32)
    grads, d_x = net.gradient(x, first, length, SIZE, keep, d_logit)
    d_word, d_gram = np.zeros_like(net.p["Ew"]), np.zeros_like(net.p["Ec"])
    np.add.at(d_word, own.word[~hidden], d_x[~hidden])
    np.add.at(d_gram, own.gram, np.repeat(d_x, grams, axis=0))
    opt.step(grads | {"Ew": d_word, "Ec": d_gram})


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Trains on rows whose crc32(doc_id) mod 3 is not 1: of each label at most ``sample`` texts and ``sample_bytes`` bytes."""
    return train(*labelled_sample(docs, labels, "toxic", 1, 3, sample, sample_bytes))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted: one row per input row, without an exchange.

    Null and empty texts, and texts without words, score 0. Whole texts are scored. The model's size is fixed.
    A null id counts as the empty text in ``held_out``. Other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.Table:
        return pa.table({"doc_id": batch.column(0), "score": pa.array(sent.value.score(utf8(batch.column(1))), pa.float64())})

    kind = docs.schema[id_col].dataType.simpleString()
    scored = arrow_map(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, score double")
    return scored.select("doc_id", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows, with all columns, that score below the threshold; rows stay where they are.

    Null and empty texts score 0 and stay. Whole texts are scored, very long ones too. Repeated rows get the same
    answer. An empty table gives an empty result; columns may have any names.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    return arrow_filter(docs, lambda piece: sent.value.score(utf8(piece.column(at))) < threshold, text_col)
