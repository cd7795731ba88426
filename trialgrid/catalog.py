"""All queries of the library and the SQL that each is compared with, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import queries_records, queries_runs

_CATALOGS = (queries_records.catalog, queries_runs.catalog)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: q for c in _CATALOGS for n, q in c.queries.items()}
SQL: dict[str, Callable[[], str]] = {n: s for c in _CATALOGS for n, s in c.sql.items()}
