"""Streaming forms of last-wins, sections and windowed summaries over an event stream.

The order within a key is event time, then event_id. Late rows are accepted up to the watermark;
what comes later still is dropped by Spark and not by these functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SECTION = "user_id long, event_type string, length long, mean double, first long, last long"
STATE = "event_type string, length long, total double, first long, last long"


def _timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need an instant


def windowed_summary(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Per window and event type: how many, the mean value, and the share out of tolerance (50 +- 45)."""
    out = F.abs(F.col("value") - 50) > 45
    grouped = _timed(events).withWatermark("ts", late).groupBy(F.window("ts", window), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.avg(out.cast("double")).alias("out_share")).select(F.col("window.start").alias("start"), "event_type", "n", "mean", "out_share")


def last_values(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """The last event of each user and type in each window."""
    return (
        _timed(events).withWatermark("ts", late)
        .groupBy(F.window("ts", window), "user_id", "event_type")
        .agg(F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("last"))
        .select(F.col("window.start").alias("start"), "user_id", "event_type", "last.event_id", "last.value")
    )


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    held = state.get if state.exists else None
    rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
    out = []
    for kind, value, event_id in zip(rows.event_type, rows.value, rows.event_id, strict=True):
        if held and held[0] == kind:
            held = (kind, held[1] + 1, held[2] + value, held[3], int(event_id))
            continue
        if held:
            out.append((key[0], held[0], held[1], held[2] / held[1], held[3], held[4]))
        held = (kind, 1, float(value), int(event_id), int(event_id))
    state.update(held)
    yield pd.DataFrame(out, columns=["user_id", "event_type", "length", "mean", "first", "last"])


def sections(events: DataFrame) -> DataFrame:
    """Finished runs of equal event type per user. A run is given out when the next begins; the open one stays in the state, of one row a user."""
    return events.groupBy("user_id").applyInPandasWithState(_advance, SECTION, STATE, "append", "NoTimeout")
