"""Structured Streaming twins of the freshness and circuit-breaker operators, over an events stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def runs_by_window(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """source_id, start, and numbers of runs and successes in tumbling windows; rows later than `late` are left out."""
    w = events.withWatermark("finished_at", late).groupBy(F.window("finished_at", length), "source_id")
    counts = w.agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "success").alias("successes"))
    return counts.select("source_id", F.col("window.start").alias("start"), "runs", "successes")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """source_id, start, end, runs of sessions that a pause of `gap` ends."""
    s = events.withWatermark("finished_at", late).groupBy(F.session_window("finished_at", gap), "source_id").agg(F.count("*").alias("runs"))
    return s.select("source_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "runs")


def circuit_breaker(events: DataFrame, threshold: int = 25) -> DataFrame:
    """source_id, streak, open: consecutive failures per source, kept as state from batch to batch; a success resets them.

    Rows of a batch are taken in the order of finished_at and event_id."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak = state.get[0] if state.exists else 0
        for frame in [pd.concat(list(frames))]:
            for status in frame.sort_values(["finished_at", "event_id"])["status"]:
                streak = streak + 1 if status == "failed" else 0 if status == "success" else streak
        state.update((streak,))
        yield pd.DataFrame({"source_id": [key[0]], "streak": [streak], "open": [streak >= threshold]})

    return events.groupBy("source_id").applyInPandasWithState(step, "source_id string, streak long, open boolean", "streak long", "update", GroupStateTimeout.NoTimeout)
