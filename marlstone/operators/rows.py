"""Small operators on rows of any table: numbers, batches, first-wins maps, labels, sums of usage and counts of states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.keyed import join_stats
from marlstone.plans.scratch import cut

#: Ranges that a table is sorted in to number its rows.
RANGES = 64


def numbered(df: DataFrame, *order: str, name: str = "n", ranges: int = RANGES) -> DataFrame:
    """df with the number, from 0, of each row in an order. Sorted by ranges of it, so no task gets all rows; rows that tie are numbered in any order."""
    parted = cut(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "numbered")
    ahead = parted.groupBy("_range").agg(F.count("*").alias("_held")).withColumn("_ahead", F.coalesce(F.sum("_held").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each range
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return parted.withColumn("_inside", inside).join(F.broadcast(ahead.select("_range", "_ahead")), "_range").select(*df.columns, (F.col("_ahead") + F.col("_inside") - 1).alias(name))


def batched(df: DataFrame, size: int, *order: str) -> DataFrame:
    """df with batch: rows in an order, in slices of a size of which only the last may be shorter."""
    if size < 1:
        raise ValueError("size must be positive")
    return numbered(df, *order, name="batch").withColumn("batch", F.floor(F.col("batch") / F.lit(size)))


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in an order: what a map keeps that later entries don't replace. Rows that tie are settled by their other columns; reduced before anything is shuffled."""
    rest = [c for c in df.columns if c not in (key, order)]
    first = df.groupBy(key).agg(F.min(F.struct(F.col(order), *rest)).alias("_x"))
    return first.select(*[F.col(key) if c == key else F.col(f"_x.{c}") for c in df.columns])


def label(df: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """df with the columns of labels (one row for each key), null where there is no label; a key of very many rows is split."""
    counts = df.groupBy(key).agg(F.count("*").alias("_rows"))
    return join_stats(df, labels.join(counts, key), key, "_rows", "left")


def usage_sum(calls: DataFrame, *keys: str) -> DataFrame:
    """(keys, tokens_in, tokens_out, cost, cached): tokens and cost of calls add up; cached only if all were."""
    return calls.groupBy(*keys).agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("cost").alias("cost"), F.bool_and("cached").alias("cached"))


def status_counts(outcomes: DataFrame, status: str = "status") -> DataFrame:
    """(status, n)."""
    return outcomes.groupBy(status).agg(F.count("*").alias("n"))


def text_of(payload: Column | None = None, text: Column | None = None, content: Column | None = None) -> Column:
    """The text of an item of any shape: the first that isn't empty of a payload's text, content and chunk (a map of strings), then its text and content; else an empty string."""
    found = [payload[k] for k in ("text", "content", "chunk")] if payload is not None else []
    found += [c for c in (text, content) if c is not None]
    return F.coalesce(*[F.when(c != "", c) for c in found], F.lit(""))
