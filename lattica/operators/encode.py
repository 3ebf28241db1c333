"""Text encoders behind one interface: a function from a list of texts to a matrix, run once per batch on the workers."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words are runs of ASCII letters, digits and underscores and of anything beyond ASCII.
WORD = re.compile("[0-9a-z_\u0080-\U0010ffff]+")
LOWER = {upper: upper + 32 for upper in range(ord("A"), ord("Z") + 1)}


def hashing_encoder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """Deterministic stand-in for a model: signed MD5 hashes of words (A-Z lower-cased), masked mean, unit length."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, text in enumerate(texts):
            tokens = WORD.findall(text.translate(LOWER))
            vecs = np.zeros((len(tokens), dim))
            for j, w in enumerate(tokens):
                h = hashlib.md5(w.encode(), usedforsecurity=False).hexdigest()
                vecs[j, int(h[:8], 16) % dim] = 1.0 if h[8] >= "8" else -1.0
            out[i] = mean_pool(vecs[None], np.ones((1, len(tokens))))[0]
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode


def mean_pool(states: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """Mean over tokens (batch, token, dim); with a mask, of the masked-in ones (their count is at least 1e-9)."""
    if mask is None:
        return states.mean(axis=1)
    return (states * mask[:, :, None]).sum(axis=1) / np.maximum(mask.sum(axis=1, keepdims=True), 1e-9)


def steadily(encoder: Callable[[list[str]], np.ndarray], texts: list[str], tries: int = 4, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> np.ndarray:
    """The encoder's rows of all texts, in order.

    A batch that is too large for memory is halved, down to single texts. Any other error is tried again after a wait
    that doubles each time, and raised after ``tries`` of them; so is the memory error of a single text.
    """
    todo, done = [texts], []
    while todo:
        batch = todo.pop()
        for n in range(tries):
            try:
                done.append(np.asarray(encoder(batch), np.float64))
                break
            except MemoryError:
                if len(batch) < 2:
                    raise
                half = (len(batch) + 1) // 2
                # The first half is on top, so rows come out in order.
                todo += [batch[half:], batch[:half]]
                break
            except Exception:
                if n == tries - 1:
                    raise
                sleep(wait * 2**n)
    return np.concatenate(done)


def encode(df: DataFrame, id_col: str, text_col: str, encoder: Callable[[list[str]], np.ndarray], batch: int = 256, tries: int = 4, wait: float = 1.0) -> DataFrame:
    """id, v; null texts count as empty. A model sees no more than ``batch`` texts at once, fewer where its memory does not hold them; failures that pass are waited out (``steadily``)."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                piece = b.slice(at, batch)
                m = steadily(encoder, [t or "" for t in piece.column(1).to_pylist()], tries, wait)
                flat = pa.array(np.ascontiguousarray(m, np.float64).ravel())
                offsets = pa.array(np.arange(0, m.size + 1, m.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.ListArray.from_arrays(offsets, flat)], ["id", "v"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, v array<double>")
