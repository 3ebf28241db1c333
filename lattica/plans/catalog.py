"""All queries of the engine's own operators, with the SQL each must agree with."""

from __future__ import annotations

from lattica.plans import graph, pathways, relational, scoring, semantics, streams, textual  # noqa: F401  (they register their queries)
from lattica.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
