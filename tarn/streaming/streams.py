"""Streaming forms of the detectors, and the state machines of the pipeline."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def recompute_changed(table: DataFrame, changed: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """compute over all rows of the keys that changed; in a stream, called from foreachBatch."""
    return compute(table.join(changed.select(key).distinct(), key, "left_semi"))


def structuring_stream(txns: DataFrame, late: str = "1 day", window: str = "7 days", slide: str = "1 day", low: float = 142_500, high: float = 150_000, least: int = 3) -> DataFrame:
    """Per sender and sliding window, payments just under the threshold."""
    near = txns.where((F.col("amount") >= low) & (F.col("amount") < high)).withWatermark("ts", late)
    x = near.groupBy(F.window("ts", window, slide), "sender").agg(F.count("*").alias("n"), F.sum("amount").alias("total"))
    return x.where(F.col("n") >= least).select(F.col("window.start").alias("start"), "sender", "n", "total")


def smurfing_stream(txns: DataFrame, late: str = "1 day", window: str = "7 days", least: int = 3, total: float = 150_000) -> DataFrame:
    """Per recipient and window, many depositors (approximately counted) and a high sum."""
    x = txns.withWatermark("ts", late).groupBy(F.window("ts", window), "receiver").agg(F.approx_count_distinct("sender").alias("depositors"), F.sum("amount").alias("total"))
    return x.where((F.col("depositors") >= least) & (F.col("total") >= total)).select(F.col("window.start").alias("start"), "receiver", "depositors", "total")


def burst_stream(events: DataFrame, gap: str = "1 hour", late: str = "1 hour", least: int = 3) -> DataFrame:
    """Sessions of an entity with at least `least` events."""
    x = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "entity").agg(F.count("*").alias("n"))
    return x.where(F.col("n") >= least).select(F.col("session_window.start").alias("start"), "entity", "n")


def velocity_stream(events: DataFrame, late: str = "1 day", window: str = "1 day") -> DataFrame:
    """Events per entity and day."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "entity").agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "entity", "n")


def dedupe_stream(alerts: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first alert of a key within the watermark."""
    return alerts.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def lockout_stream(attempts: DataFrame, most: int = 5, window_s: int = 900, late: str = "10 minutes") -> DataFrame:
    """(key, failures, blocked) after each batch: failures of the last `window_s` seconds, cleared by a success. A key is forgotten when the watermark is past its window."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = list(state.get[0]) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            return
        for pdf in batches:
            for at, ok in sorted(zip(pdf["ts"].astype("datetime64[us]").astype("int64") / 1e6, pdf["ok"], strict=True)):
                times = [] if ok else [x for x in times if x > at - window_s] + [float(at)]
        state.update((times,))
        state.setTimeoutTimestamp(max(int((max(times, default=0) + window_s) * 1000), state.getCurrentWatermarkMs() + 1000))
        yield pd.DataFrame({"key": [key[0]], "failures": [len(times)], "blocked": [len(times) >= most]})

    return attempts.withWatermark("ts", late).groupBy("key").applyInPandasWithState(step, "key string, failures long, blocked boolean", "times array<double>", "update", GroupStateTimeout.EventTimeTimeout)


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append"):
    """Processes what is there, into a memory table, and stops."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def staged(stream: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]], sink: Callable[[str, DataFrame, int], None], checkpoint: str, retries: int = 3):
    """Each batch through named stages in order; a failing stage or sink is tried again up to `retries` times on the stage's own input.

    What a stage gives goes to sink(stage, rows, batch). A sink that failed half-way gets the same (stage, batch) again, and so does every
    sink if the batch is run again, so it must overwrite by these two: as a folder of that name, or a merge by key.
    """

    def each(batch: DataFrame, number: int) -> None:
        rows = batch
        for name, f in stages:
            for left in range(retries, -1, -1):
                try:
                    made = f(rows)
                    sink(name, made, number)
                    rows = made
                    break
                except Exception:
                    if not left:
                        raise

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
