"""Registered queries over the star-schema tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def registry() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    from tessitura.plans import catalog, feel, frames, learned, retrieval, serving, stateful

    queries: dict[str, Callable] = {}
    oracles: dict[str, str] = {}
    for part in (retrieval, frames, catalog, serving, feel, learned, stateful):
        queries |= part.QUERIES
        oracles |= part.ORACLES
    return queries, oracles
