"""Queries over the test tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def registry() -> tuple[dict[str, Query], dict[str, str]]:
    from tidewrack.plans import composites, graphs, joins, profiles, rankings, scalars, semistructured, stages, steps

    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}
    for module in (profiles, rankings, scalars, joins, graphs, semistructured, composites, stages, steps):
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql
