"""Windows over event time, the same for batch and for streams, and stateful rate limits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Seconds that a request is remembered.
SPAN = 60.0


def tumbling(events: DataFrame, size: str = "1 hour", keys: tuple[str, ...] = ("event_type",), delay: str | None = None) -> DataFrame:
    """(start, keys, events, total)."""
    rows = events.withWatermark("ts", delay) if delay else events
    return rows.groupBy(F.window("ts", size).alias("w"), *keys).agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "events", "total")


def sliding(events: DataFrame, size: str = "1 hour", slide: str = "15 minutes", keys: tuple[str, ...] = (), delay: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", delay) if delay else events
    return rows.groupBy(F.window("ts", size, slide).alias("w"), *keys).agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), *keys, "events")


def sessions(events: DataFrame, gap: str = "30 minutes", key: str = "user_id", delay: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", delay) if delay else events
    return rows.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def deduplicate(events: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """Rows of a stream without repeats of a key within the watermark's delay; of a batch without any."""
    rows = events.withWatermark("ts", delay)
    return rows.dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def late(events: DataFrame, delay_s: float, order: str = "event_id") -> DataFrame:
    """Rows that come, in the order of arrival within their event_type, later than the newest before them by more than the delay."""
    by = Window.partitionBy("event_type").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("newest", F.max("ts").over(by)).filter(F.col("newest").cast("timestamp").cast("double") - F.col("ts").cast("timestamp").cast("double") > delay_s)


def rate_60s(events: DataFrame, key: str = "user_id") -> DataFrame:
    """events with in_window: how many of a key's events lie in the 60 seconds up to each."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-int(SPAN * 1_000_000), 0)
    return events.withColumn("in_window", F.count("*").over(w))


def admit(times: list[float], limit: int, held: list[float] | None = None) -> tuple[list[bool], list[float]]:
    """Which of a key's requests, in order of time, a limit per 60 seconds admits; and the admitted ones that are still remembered."""
    window, out = list(held or []), []
    for t in times:
        window = [x for x in window if t - x < SPAN]
        out.append(len(window) < limit)
        if out[-1]:
            window.append(t)
    return out, window


def admitted(events: DataFrame, limit: int, key: str = "user_id", order: str = "event_id") -> DataFrame:
    """(key, order, admitted): replay of the limiter over a batch, each key in order of time."""
    kinds = dict(events.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["t", order], kind="stable")
        return pd.DataFrame({key: rows[key], order: rows[order], "admitted": admit(rows["t"].tolist(), limit)[0]})

    return events.select(key, order, F.col("ts").cast("timestamp").cast("double").alias("t")).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, admitted boolean")


def admitted_stream(events: DataFrame, limit: int, key: str = "user_id", order: str = "event_id") -> DataFrame:
    """The limiter over a stream: the admitted times of the last 60 seconds are a key's state, dropped when nothing came for as long."""
    kinds = dict(events.dtypes)

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["t", order], kind="stable")
        ok, held = admit(rows["t"].tolist(), limit, list(state.get[0]) if state.exists else [])
        state.update((held,))
        state.setTimeoutDuration(int(SPAN * 1000))
        yield pd.DataFrame({key: k[0], order: rows[order], "admitted": ok})

    return events.select(key, order, F.col("ts").cast("timestamp").cast("double").alias("t")).groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {order} {kinds[order]}, admitted boolean", "held array<double>", "append", "ProcessingTimeTimeout")


def ingest(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True):
    """Run apply(batch, number) for each micro-batch; the checkpoint remembers what is done, so a restart goes on from there."""
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
