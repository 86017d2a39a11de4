"""All registered queries of the listing engine, by name."""

from __future__ import annotations

from collections.abc import Callable

from listwright.queries import apis, incremental, pages, places, projections, readers, relational, repairs, resolution, sites, stores, upkeep  # noqa: F401
from listwright.queries.registry import QUERIES, SQL

FLAGSHIP = "dedup_greedy"


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
