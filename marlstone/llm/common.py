"""Helpers that several operators share: scratch tables and joins on keys that may be hot."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from marlstone.operators.keyed import HOT_ROWS, join_stats
from marlstone.plans.scratch import cut as materialise
from marlstone.plans.scratch import folder as scratch_path
from marlstone.plans.scratch import plain_unions

__all__ = ["HOT_ROWS", "join_stats", "map_rows", "materialise", "placed", "plain_unions", "scratch_path", "signed", "table"]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    plain_unions(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], longs: Sequence[str] = ()) -> DataFrame:
    """df through mapInArrow, whatever its columns are called (they are c0, c1 and so on in run), with further columns of longs."""
    names = [f"c{k}" for k in range(len(df.columns))]
    schema = S.StructType([*(S.StructField(n, f.dataType) for n, f in zip(names, df.schema.fields, strict=True)), *(S.StructField(c, S.LongType()) for c in longs)])
    return df.toDF(*names).mapInArrow(run, schema).toDF(*df.columns, *longs)


def placed(docs: DataFrame) -> tuple[DataFrame, Column, Column]:
    """docs and, of each row, its file (hashed) and its place in it, which tell rows apart. What isn't a table's scan is written first."""
    try:
        at = docs.metadataColumn("_metadata")
        docs.select(at["row_index"])
    except AnalysisException:
        docs = materialise(docs, "placed")
        at = docs.metadataColumn("_metadata")
    return docs, F.xxhash64(at["file_path"]), at["row_index"]


def signed(value: Column) -> Column:
    """A long's bits as 16 hexadecimal digits."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))
