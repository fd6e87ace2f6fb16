"""Joins on keys of which some may have very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with at least this many rows is hot: its row of the other side is broadcast. There are at most rows / HOT_ROWS such keys.
HOT_ROWS = 200_000
#: No more hot keys than this are broadcast (about 10 MB of keys); beyond it the threshold is raised.
MAX_HOT_KEYS = 100_000


def join_stats(left: DataFrame, stats: DataFrame, key: str, count: str, how: str = "inner", hot_rows: int = HOT_ROWS, hint: str | None = None) -> DataFrame:
    """Join left with stats (one row for each key, with the number of left rows in count) so that no task gets all rows of a hot key.

    Rows of keys with hot_rows or more meet a broadcast of those keys' stats, of which there are at most rows / hot_rows; all
    others meet in a shuffle, in which a key has fewer than hot_rows rows. how: inner or left; hint: how the others are to be
    joined. The result has left's columns and those of stats but count.
    """
    values = [c for c in stats.columns if c not in (key, count)]
    hot = stats.filter(F.col(count) >= hot_rows)
    n_hot = hot.limit(MAX_HOT_KEYS + 1).count()
    if n_hot > MAX_HOT_KEYS:
        return join_stats(left, stats, key, count, how, hot_rows * 8, hint)
    cold = stats.filter(F.col(count) < hot_rows).select(key, *values)
    cold = cold.hint(hint) if hint else cold
    if not n_hot:
        return left.join(cold, key, how).select(*left.columns, *values)
    hot = F.broadcast(hot.select(key, *values))
    met = left.join(hot, key, "inner").select(*left.columns, *values)
    rest = left.join(hot.select(key), key, "left_anti").join(cold, key, how).select(*left.columns, *values)
    return met.unionByName(rest)


def follow(rows: DataFrame, to: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """rows with the columns of to, which has one row for each key; rows whose key isn't there go. Hash joins, in which no task gets all rows of a hot key."""
    counts = rows.groupBy(key).agg(F.count("*").alias("asking"))
    return join_stats(rows, to.join(counts.hint("shuffle_hash"), key), key, "asking", "inner", hot_rows, "shuffle_hash")
