"""Structured Streaming: thread sessions and trace progress over parsed events as they come."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.levels import is_error


def thread_sessions(events: DataFrame, gap_seconds: int = 30, late: str = "1 minute") -> DataFrame:
    """Sessions of each thread, cut at pauses longer than the gap; append mode gives them when the watermark has passed."""
    bad = is_error(F.col("level"), F.col("exception"), F.col("http"))
    window = F.session_window("ts", f"{gap_seconds} seconds")  # a pause as long as the gap does not cut
    d = events.where("thread IS NOT NULL").withWatermark("ts", late).groupBy("thread", window)
    return d.agg(F.count("*").alias("events"), F.count_if(bad).alias("errors"), F.min("ts").alias("start"), F.max("ts").alias("end")).drop("session_window")


def level_counts(events: DataFrame, every: str = "1 minute", late: str = "1 minute") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "level").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "level", "n")


INHERITED = "seq long, thread string, trace_id string"


def inherited_traces(events: DataFrame, window_seconds: int = 10) -> DataFrame:
    """seq, thread, trace_id: rows without a trace take their thread's active one; state per thread, dropped after an idle window."""

    def step(key: tuple, frames: Iterator[Any], state: Any) -> Iterator[Any]:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        active, last = state.get if state.exists else (None, None)
        rows = pd.concat(list(frames)).sort_values(["ts", "seq"])
        found = []
        for r in rows.itertuples(index=False):
            at = int(r.ts.value // 1000) if r.ts is not pd.NaT else last
            if last is not None and at is not None and at - last > window_seconds * 1_000_000:
                active = None
            active, last = (r.trace_id or active), at
            found.append((r.seq, key[0], active))
        state.update((active, last))
        state.setTimeoutDuration(max(1, window_seconds) * 1000)
        yield pd.DataFrame(found, columns=["seq", "thread", "trace_id"])

    keyed = events.where("thread IS NOT NULL").select("seq", "ts", "thread", "trace_id")
    return keyed.groupBy("thread").applyInPandasWithState(step, INHERITED, "trace string, last long", "append", "ProcessingTimeTimeout")
