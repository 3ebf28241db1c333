"""Stateful packing of paragraphs and sentences into chunks, by Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")
SECTION = re.compile(r"^## |\n## ", re.MULTILINE)


class _Open:
    """The chunk being filled."""

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.size = 0

    def add(self, piece: str, size: int) -> None:
        self.pieces.append(piece)
        self.size += size

    def text(self) -> str:
        return " ".join(self.pieces)


def pack_words(text: str, target: int = 512, overlap: int = 50) -> Iterator[tuple[str, int, int]]:
    """(text, section, words) of chunks of about ``target`` words.

    Chunks don't cross sections. Paragraphs stay whole unless they exceed the target; those go sentence by sentence,
    and a chunk closed there with more than one piece hands its last ``overlap`` words to the next.
    """
    for number, section in enumerate(SECTION.split(text)):
        if not section.strip():
            continue
        now = _Open()
        for paragraph in ("## " * (number > 0) + section).split("\n\n"):
            paragraph = paragraph.strip()
            if not paragraph:
                continue
            long = len(paragraph.split()) > target
            for piece in SENTENCE.split(paragraph) if long else [paragraph]:
                size = len(piece.split())
                if now.pieces and now.size + size > target:
                    yield now.text(), number, now.size
                    last, now = now, _Open()
                    if long and overlap > 0 and len(last.pieces) > 1:
                        tail = last.text().split()[-overlap:]
                        now.add(" ".join(tail), len(tail))
                now.add(piece, size)
        if now.pieces:
            yield now.text(), number, now.size


def pack_chars(text: str, target: int = 1000) -> Iterator[tuple[str, int, int]]:
    """(text, start, end) of chunks of about ``target`` characters; joining spaces don't count, places are those of the joined text.

    A chunk closed within a long paragraph hands on its last two pieces if it has more than two, else its last.
    """
    now, at = _Open(), 0
    for paragraph in text.split("\n\n"):
        long = len(paragraph) > target
        for piece in SENTENCE.split(paragraph) if long else [paragraph]:
            if now.pieces and now.size + len(piece) > target:
                done = now.text()
                yield done, at, at + len(done)
                at += len(done)
                last, now = now.pieces, _Open()
                if long:
                    tail = " ".join(last[-2:] if len(last) > 2 else last[-1:])
                    if tail:
                        now.add(tail, len(tail))
                    at -= len(tail)
            now.add(piece, len(piece))
    if now.pieces:
        yield now.text(), at, at + len(now.text())


def packed_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: str = "words", target: int | None = None, overlap: int = 50) -> DataFrame:
    """doc_id, chunk_index, text and section, tokens (by words) or start_char, end_char (by chars)."""
    if by not in ("words", "chars"):
        raise ValueError(f"unknown packer {by!r}")
    names = ("section", "tokens") if by == "words" else ("start_char", "end_char")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, index, texts, a, b = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                chunks = pack_words(text or "", target or 512, overlap) if by == "words" else pack_chars(text or "", target or 1000) if text else ()
                for k, (t, x, y) in enumerate(chunks):
                    at.append(i)
                    index.append(k)
                    texts.append(t)
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(index, pa.int32()), pa.array(texts, pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["doc_id", "chunk_index", "text", *names])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, chunk_index int, text string, {names[0]} int, {names[1]} int")
