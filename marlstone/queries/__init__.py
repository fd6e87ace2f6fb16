"""Every query of the engine's own operators, with equal SQL where there is some."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.queries import links, search, tables, texts
from marlstone.queries.base import Query, wide

ALL: dict[str, Query] = {**search.QUERIES, **texts.QUERIES, **tables.QUERIES, **links.QUERIES}


def _wide(query: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: wide(query.run(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _wide(q) for name, q in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in ALL.items() if q.sql}
