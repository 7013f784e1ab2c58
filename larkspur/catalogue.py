"""Queries over the driver's tables, one for each operator family, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can express it, its DuckDB twin."""

    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return keep


for _module in ("relational", "reconciliation", "catalog", "scalars", "operations", "streams", "merging", "assessments", "stated", "extraction", "delivery", "selection", "publishing", "lists", "repairs", "postings", "facets", "evidence"):
    import_module(f"larkspur.queries.{_module}")
