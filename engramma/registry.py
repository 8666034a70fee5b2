"""All queries outside the training-data subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from engramma.queries import answers, changes, enriched, imports, memory, passages, retrieval, samples, sqlfuncs, star, stores

MODULES = (passages, memory, stores, answers, enriched, imports, star, retrieval, changes, samples, sqlfuncs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
