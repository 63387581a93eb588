"""Named queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from quillsift.plans.queries import events, filters, indexes, rows, texts  # noqa: F401  (each registers its own)
from quillsift.plans.queries.base import REGISTERED, Query
from quillsift.plans.queries.indexes import flagship_facets as flagship


def queries() -> dict[str, Query]:
    return {name: run for name, (run, _) in REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTERED.items()}


__all__ = ["flagship", "oracle_sql", "queries"]
