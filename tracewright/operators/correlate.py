"""Events into incidents: by trace, request, thread context, session, own keys, thread and file.

A row without an id of its own takes the active trace or request of its thread, which every member of the chain keeps
alive for the inherit window.  Rows that are left make thread groups, cut at long pauses, and rows without a thread file groups.
Points that the observed behaviour leaves open: rows go by (ts, seq); a pause longer than the limit cuts, one as long does
not; an undated row counts as no pause; only traces and requests are context; own keys count as requests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Correlation
from ..functions.levels import is_error
from .scan import cuts, whole


def in_time() -> list[Column]:
    return [F.col("ts").isNull(), F.col("ts"), F.col("seq")]


def by_time(seconds: int) -> Column | None:
    """Blocks of a scan in time order; undated rows come last."""
    return F.coalesce(F.floor(F.unix_micros("ts") / (seconds * 1_000_000)), F.lit((1 << 63) - 1)) if seconds else None


def _key(kind: str, key: Column) -> Column:
    return F.when(key.isNotNull(), F.struct(F.lit(kind).alias("kind"), key.alias("key")))


def _pauses(rows: DataFrame, key: list[str], seconds: int, name: str, block: Column | None, alive: tuple[str, Column] | None = None) -> DataFrame:
    """Adds how many pauses longer than the limit lie before a row, and the last value that is still alive."""
    longer = lambda now, before: now["us"] - before["us"] > seconds * 1_000_000
    return cuts(rows, key, in_time(), longer, {"us": F.unix_micros("ts")}, block, name, alive)


def own_key(settings: Correlation) -> Column:
    columns = {"TRACE": "trace_id", "REQUEST": "request_id"}
    keys = [_key(k, F.col(columns[k])) for k in settings.priority if k in columns]
    return F.coalesce(*keys) if keys else F.lit(None).cast("struct<kind:string,key:string>")


def with_context(events: DataFrame, settings: Correlation) -> DataFrame:
    """Adds own and, where it is null, the thread's active chain."""
    d = events.withColumn("corr", own_key(settings))
    if not settings.inherit_trace_from_thread:
        return d
    d = _pauses(d, ["thread"], settings.inherit_window_seconds, "seg", by_time(settings.block_seconds), ("active", F.col("corr")))
    return d.withColumn("corr", F.when(F.col("thread").isNotNull(), F.coalesce("corr", "active")).otherwise(F.col("corr"))).drop("seg", "active")


def correlate(events: DataFrame, settings: Correlation = Correlation()) -> DataFrame:
    """events with corr_kind and corr_key; rows that belong nowhere are dropped if there is no falling back to files."""
    d = with_context(events, settings)
    later = [_key("SESSION", F.col("session_id"))] if "SESSION" in settings.priority else []
    later += [_key("REQUEST", F.nullif(F.try_element_at("attributes", F.lit(k)), F.lit(""))) for k in settings.additional_keys]
    d = d.withColumn("corr", F.coalesce("corr", *later))
    if "THREAD" in settings.priority:
        left = F.col("corr").isNull() & F.col("thread").isNotNull()
        # of a thread only the rows that are left count; the others stay in partitions of their own
        d = _pauses(d.withColumn("left", left), ["thread", "left"], settings.thread_gap_seconds, "nth", by_time(settings.block_seconds))
        d = d.drop("left").withColumn("nth", F.col("nth") + 1)
        name = F.when(F.col("nth") > 1, F.concat("thread", F.lit("#"), F.col("nth").cast("string"))).otherwise(F.col("thread"))
        d = d.withColumn("corr", F.coalesce("corr", _key("THREAD", F.when(F.col("thread").isNotNull(), name)))).drop("nth")
    if settings.fallback_to_file:
        d = d.withColumn("corr", F.coalesce("corr", _key("FILE", F.coalesce("source_file", F.lit("")))))
    d = d.where(F.col("corr").isNotNull()).select(*events.columns, F.col("corr.kind").alias("corr_kind"), F.col("corr.key").alias("corr_key"))
    if settings.min_events_per_timeline > 0:
        bad = is_error(F.col("level"), F.col("exception"), F.col("http"))
        d = whole(d, ["corr_kind", "corr_key"], {"n": F.count(F.lit(1)), "bad": F.bool_or(bad)}, bool(settings.block_seconds))
        d = d.where((F.col("n") >= settings.min_events_per_timeline) | F.col("bad")).drop("n", "bad")
    return d
