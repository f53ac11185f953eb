"""All queries of the library outside the optional llm subpackage, with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfwise.plans import baseline, board, catalog, decisions, markup, serving, titles

MODULES: list = [catalog, titles, serving, decisions, board, markup, baseline]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict = {}
    for module in MODULES:
        found.update(module.QUERIES)
    return found


def oracle_sql() -> dict[str, str]:
    found: dict = {}
    for module in MODULES:
        found.update(module.ORACLES)
    return found
