"""Quality scores: random-indexing word vectors, pooled per document, and a two-layer network.

Random indexing: every token (hashed into ``1 << BITS`` rows) has a sparse random index vector of +1 and -1; the index
vectors of a token's neighbours, summed over the whole corpus, are its context vector. The table has a fixed size.
Every task sums its own rows; the sums meet in rounds of ``FAN_IN``, in slices of the table, so no task holds more than
slices. Context vectors are centred and scaled into word vectors. A document is pooled into the mean and the spread of
its word vectors and the mean product of neighbours'. A network of two layers, trained on a bounded sample of labelled
rows, gives a logit; a temperature fitted on rows held back from training makes it a probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import arrow_map, bound_batches, pieces, utf8
from lattica.llm.recurrent import Adam, sigmoid
from lattica.llm.samples import SAMPLE_BYTES, labelled_sample
from lattica.llm.words import mix, range_hashes, word_hashes

BITS, DIM, NONZERO, REACH = 15, 32, 4, 2
SLICES, FAN_IN = 64, 32
SAMPLE, HIDDEN, STEPS, BATCH = 3000, 24, 1500, 256
THRESHOLD = 0.3
ROWS, WIDE = 1 << BITS, DIM + 1
FEATURES = 3 * DIM + 2
#: 0 white space and control, 1 letters, digits and other UTF-8, 2 other signs.
KIND = np.array([0 if b <= 32 or b == 127 else 1 if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 2 for b in range(256)], np.int8)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Row of each token, case kept, runs of signs are tokens too; and the first token of each text."""
    buf = np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)
    kind = KIND[buf]
    edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    starts = edge[kind[edge] > 0]
    ends = edge[np.searchsorted(edge, starts, "right")] if len(starts) else starts
    row = (word_hashes(buf, starts, ends, 3) >> np.uint64(64 - BITS)).astype(np.int64)
    sizes = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    return row, np.concatenate([[0], np.searchsorted(starts, sizes + 1)])


@lru_cache(maxsize=1)
def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of each row's index vector."""
    h = mix(np.arange(ROWS * NONZERO, dtype=np.uint64).reshape(ROWS, NONZERO) + np.uint64(1 << 40))
    block = DIM // NONZERO
    places = (h % np.uint64(block)).astype(np.int64) + np.arange(NONZERO) * block
    return places, np.where((h >> np.uint64(33)) & np.uint64(1), 1.0, -1.0)


def context_sums(row: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """ROWS x WIDE: sums of neighbours' index vectors by token, and the token's count last. Neighbours are of one text."""
    places, signs = index_vectors()
    text = np.repeat(np.arange(len(bound) - 1), np.diff(bound))
    out = np.zeros(ROWS * WIDE)
    for d in range(1, REACH + 1):
        near = np.flatnonzero(text[d:] == text[:-d])
        a, b = row[near], row[near + d]
        for x, y in ((a, b), (b, a)):
            at = (x * WIDE)[:, None] + places[y]
            out += np.bincount(at.ravel(), signs[y].ravel(), ROWS * WIDE)
    out = out.reshape(ROWS, WIDE)
    out[:, DIM] = np.bincount(row, minlength=ROWS)
    return out


def _emit(total: np.ndarray, run: int) -> pa.RecordBatch:
    cut = total.reshape(SLICES, -1)
    return pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([run] * SLICES, pa.int32()), pa.array([c.tobytes() for c in cut], pa.binary())], ["slice", "run", "sums"])


SUMS = "slice int, run int, sums binary"


def corpus_sums(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Context sums over all rows and whole texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, some = np.zeros((ROWS, WIDE)), False
        for batch in batches:
            for piece in pieces(batch, 0):
                total += context_sums(*tokens(utf8(piece.column(0))))
                some = True
        if some:
            yield _emit(total, TaskContext.get().partitionId())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for s, r, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got = np.frombuffer(x)
                held[s, r] = held[s, r] + got if (s, r) in held else got
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.int32()), pa.array([k[1] for k in held], pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["slice", "run", "sums"])

    bound_batches(docs.sparkSession)
    runs = docs.select(F.col(text_col).alias("text")).mapInArrow(count, SUMS)
    n = max(1, docs.select(text_col).rdd.getNumPartitions())
    for _ in range(max(1, math.ceil(math.log(n, FAN_IN) - 1e-9))):
        runs = runs.withColumn("run", F.floor(F.col("run") / FAN_IN).cast("int")).repartition(SLICES, "slice", "run").mapInArrow(merge, SUMS)
    total = np.zeros((SLICES, ROWS * WIDE // SLICES))
    for r in runs.collect():  # the table: SLICES rows of fixed size
        total[r["slice"]] += np.frombuffer(r["sums"])
    return total.reshape(ROWS, WIDE)


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Centred unit context vectors, damped for frequent tokens; the damping is the last column."""
    count = sums[:, DIM]
    share = count / max(1.0, count.sum())
    v = sums[:, :DIM] / np.maximum(np.linalg.norm(sums[:, :DIM], axis=1, keepdims=True), 1e-9)
    v = v - (share[:, None] * v).sum(axis=0)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    damp = 1e-3 / (1e-3 + share)
    return np.concatenate([v, damp[:, None]], axis=1).astype(np.float32)


def pool(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """FEATURES of each text; zeros without tokens."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    row, bound = tokens(texts)
    size = np.diff(bound)
    full = np.flatnonzero(size)
    if not len(full):
        return out
    x = vectors[row]
    at = bound[:-1][full]
    n = size[full][:, None].astype(np.float32)
    mean = np.add.reduceat(x, at, axis=0) / n
    square = np.add.reduceat(x[:, :DIM] ** 2, at, axis=0) / n
    pair = x[:, :DIM].copy()
    pair[:-1] *= x[1:, :DIM]
    pair[bound[1:][full] - 1] = 0
    pair = np.add.reduceat(pair, at, axis=0) / np.maximum(n - 1, 1)
    out[full] = np.concatenate([mean[:, :DIM], np.sqrt(np.maximum(square - mean[:, :DIM] ** 2, 0)), pair, mean[:, DIM:], np.log1p(n)], axis=1)
    return out


class Model:
    """Word vectors, scaling of features, two layers and a temperature."""

    def __init__(self, vectors: np.ndarray, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.vectors = vectors
        self.centre, self.scale = np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32)
        self.p = {"w1": rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)).astype(np.float32), "b1": np.zeros(HIDDEN, np.float32), "w2": np.zeros(HIDDEN, np.float32), "b2": np.zeros(1, np.float32)}
        self.temperature = 1.0

    def logits(self, features: np.ndarray) -> np.ndarray:
        x = np.clip((features - self.centre) / self.scale, -8, 8)
        return np.tanh(x @ self.p["w1"] + self.p["b1"]) @ self.p["w2"] + self.p["b2"][0]

    def score(self, texts: list[bytes]) -> np.ndarray:
        return sigmoid(self.logits(pool(texts, self.vectors)).astype(np.float64) / self.temperature)


def train(model: Model, texts: list[bytes], y: np.ndarray, seed: int = 11) -> Model:
    """Trains on texts whose labels are as frequent as they come; a quarter sets the temperature."""
    if not len(texts):
        return model
    x = np.concatenate([pool(texts[i : i + 256], model.vectors) for i in range(0, len(texts), 256)])
    rng = np.random.default_rng(seed)
    held = rng.random(len(y)) < 0.25
    if held.all() or not held.any():
        held[:] = False
    model.centre, model.scale = x[~held].mean(axis=0), x[~held].std(axis=0) + 1e-3
    z = np.clip((x - model.centre) / model.scale, -8, 8)
    learn = np.flatnonzero(~held)
    opt = Adam(model.p, 0.005)
    for _ in range(STEPS):
        i = rng.choice(learn, min(BATCH, len(learn)), replace=False)
        a = np.tanh(z[i] @ model.p["w1"] + model.p["b1"])
        d = ((sigmoid(a @ model.p["w2"] + model.p["b2"][0]) - y[i]) / len(i)).astype(np.float32)
        da = d[:, None] * model.p["w2"] * (1 - a**2)
        opt.step({"w2": a.T @ d, "b2": d.sum(keepdims=True), "w1": z[i].T @ da, "b1": da.sum(axis=0)}, 1e-3)
    tune = np.flatnonzero(held) if held.any() else learn
    logit, target = model.logits(x[tune]).astype(np.float64), y[tune]
    temperatures = np.geomspace(0.25, 8, 61)
    loss = [np.logaddexp(0, np.where(target == 1, -logit, logit) / t).mean() for t in temperatures]
    model.temperature = float(temperatures[int(np.argmin(loss))])
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Word vectors from all documents; labels only from rows whose crc32(doc_id) mod 5 is not 0, of each label at most ``sample`` texts and ``sample_bytes`` bytes."""
    model = Model(word_vectors(corpus_sums(docs)))
    return train(model, *labelled_sample(docs, labels, "quality", 0, 5, sample, sample_bytes))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted: one row per input row, without an exchange.

    Null and empty texts have all features zero and get the network's answer to that. Whole texts are pooled.
    A null id counts as the empty text in ``held_out``. Other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.Table:
        return pa.table({"doc_id": batch.column(0), "score": pa.array(sent.value.score(utf8(batch.column(1))), pa.float64())})

    kind = docs.schema[id_col].dataType.simpleString()
    scored = arrow_map(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, score double")
    return scored.select("doc_id", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
