"""Papers and chunks in JSON files as a data source of Spark: ``spark.read.format("paper_json")``.

Each file is a paper. Files are listed once, dealt into partitions by size, and read on the workers through pyarrow's
file systems, so a path may name any store those know. A file bears its paper's id, with '/' as '_', so equality and
membership filters on the id leave out the files of others before they are opened.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

PAPERS = "id string, title string, abstract string, categories array<string>, year int, markdown string, embedding array<float>"
CHUNKS = "paper_id string, chunk_id int, text string, start_char int, end_char int, embedding array<float>"
#: Bytes of files of a partition, about.
PART_BYTES = 32 << 20


class Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class PaperJson(DataSource):
    """Options: ``path``, a folder; ``kind``, papers (the default) or chunks; ``partBytes``, the size of a partition."""

    @classmethod
    def name(cls) -> str:
        return "paper_json"

    def schema(self) -> str:
        kind = self.options.get("kind", "papers")
        if kind not in ("papers", "chunks"):
            raise ValueError(f"unknown kind {kind!r}")
        return PAPERS if kind == "papers" else CHUNKS

    def reader(self, schema: object) -> PaperReader:
        return PaperReader(dict(self.options))


class PaperReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.chunks, self.most = options["path"], options.get("kind") == "chunks", int(options.get("partbytes", options.get("partBytes", PART_BYTES)))
        self.ids: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        key = "paper_id" if self.chunks else "id"
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == (key,):
                wanted = set(f.value) if isinstance(f, In) else {f.value}
                self.ids = wanted if self.ids is None else self.ids & wanted
            yield f  # Spark still applies it: different ids may share a file name

    def partitions(self) -> list[Files]:
        store, folder = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        found = [f for f in store.get_file_info(fs.FileSelector(folder)) if f.is_file and f.path.endswith(".json")]
        if self.ids is not None:
            names = {f"{i.replace('/', '_')}.json" for i in self.ids}
            found = [f for f in found if f.base_name in names]
        groups: list[list[str]] = []
        held = 0
        for f in sorted(found, key=lambda f: f.path):
            if not groups or held + f.size > self.most:
                groups.append([])
                held = 0
            groups[-1].append(f.path)
            held += f.size
        return [Files(g) for g in groups] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        for path in partition.paths:
            with store.open_input_stream(path) as f:
                doc = json.loads(f.read())
            if self.chunks:
                for c in doc.get("chunks") or []:
                    if c.get("embedding"):
                        yield doc.get("paper_id"), c.get("chunk_id"), c.get("text"), c.get("start_char"), c.get("end_char"), [float(x) for x in c["embedding"]]
            else:
                vector = doc.get("embeddings")
                yield doc.get("id"), doc.get("title"), doc.get("abstract"), doc.get("categories"), doc.get("year"), (doc.get("pdf_content") or {}).get("markdown"), None if vector is None else [float(x) for x in vector]


def register(spark: SparkSession) -> None:
    """Makes the source known to the session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PaperJson)
