"""What the query modules share."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from marlstone.plans.scratch import plain_unions


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    plain_unions(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide(df: DataFrame) -> DataFrame:
    """Integers as long, floats as double, arrays as text: types that both engines print alike."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (S.ByteType, S.ShortType, S.IntegerType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (S.FloatType, S.DecimalType)):
            c = c.cast("double")
        elif isinstance(f.dataType, S.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def literals(columns: str, rows: list[tuple]) -> tuple[Callable[[SparkSession], DataFrame], str]:
    """A small fixture as a DataFrame (from a DDL schema) and as SQL."""

    def sql(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(map(sql, v)) + "]"
        return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    names = ", ".join(c.split()[0] for c in columns.split(", "))
    body = "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(sql, r)) + ")" for r in rows) + f") AS v({names})"
    return (lambda spark: spark.createDataFrame(rows, columns)), body


def words(items) -> str:
    return "(" + ", ".join(f"'{w}'" for w in items) + ")"
