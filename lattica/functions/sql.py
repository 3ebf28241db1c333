"""The engine's functions for users of SQL: scalar ones stay in the JVM, packers are a table function in Python."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from lattica.functions.packers import pack_chars, pack_words
from lattica.functions.scores import ALPHA

FUNCTIONS = [
    f"amplify(context DOUBLE, alpha DOUBLE DEFAULT {ALPHA}) RETURNS DOUBLE RETURN pow(context, alpha)",
    f"transfer(ground_a DOUBLE, ground_b DOUBLE, context DOUBLE, alpha DOUBLE DEFAULT {ALPHA}) RETURNS DOUBLE RETURN (ground_a + ground_b) / 2 * pow(context, alpha)",
    "information(dims ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(dims, 1D, (p, x) -> p * coalesce(x, 0D))",
    "vector_norm(v ARRAY<DOUBLE>) RETURNS DOUBLE RETURN sqrt(aggregate(v, 0D, (s, x) -> s + x * x))",
    "cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / nullif(vector_norm(a) * vector_norm(b), 0D)",
    # An array, named in a subquery and exploded outside it: a table function in SQL would join on whole texts.
    r"word_windows(body STRING, size INT, overlap INT DEFAULT 0) RETURNS ARRAY<STRING> RETURN transform(array(filter(split(coalesce(body, ''), '\\s+'), x -> x <> '')), w -> transform(if(size(w) > 0, sequence(0, size(w) - 1, size - overlap), array()), i -> array_join(slice(w, i + 1, size), ' ')))[0]",
]


@udtf(returnType="chunk_index int, chunk string, first int, last int")
class Packed:
    """Chunks of one text by words (first: section, last: words) or chars (first and last: places). Null has none."""

    def eval(self, text: str, by: str, target: int) -> Iterator[tuple[int, str, int, int]]:
        if by not in ("words", "chars"):
            raise ValueError(f"unknown packer {by!r}")
        pack = pack_words if by == "words" else pack_chars
        for i, (chunk, first, last) in enumerate(pack(text, target) if text else ()):
            yield i, chunk, first, last


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL, as temporary ones; ``packed`` is used by LATERAL joins."""
    for body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {body}")
    spark.udtf.register("packed", Packed)
