"""Filters before and after the analysis."""

from __future__ import annotations

import re
from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.levels import at_least


#: A moment with its offset, or a local date and time.
MOMENT = re.compile(r"\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?|T\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?(?:Z|[+-]\d{2}:\d{2}))", re.IGNORECASE)


def parse_time(value: str | None, zone: str | None = None) -> datetime | None:
    """A moment as people give it; without an offset it is meant in the zone, by default that of the system.  Blank: none."""
    text = (value or "").strip()
    if not text:
        return None
    if MOMENT.fullmatch(text):
        try:
            found = datetime.fromisoformat(re.sub(r"(\.\d{6})\d+", r"\1", text.upper()))
            return found if found.tzinfo else found.replace(tzinfo=ZoneInfo(zone)) if zone else found.astimezone()
        except ValueError:  # such as a 30th of February
            pass
    raise ValueError(f"cannot read the time {value!r}; give it like 2026-08-09T10:00:00 or 2026-08-09T10:00:00Z")


def filter_events(events: DataFrame, since: str | datetime | None = None, until: str | datetime | None = None, min_level: str | None = None) -> DataFrame:
    """Bounds are inclusive; undated events pass them.  Applied before correlation: what falls joins no timeline."""
    d = events
    if since:
        d = d.where(F.col("ts").isNull() | (F.col("ts") >= F.lit(since).cast("timestamp")))
    if until:
        d = d.where(F.col("ts").isNull() | (F.col("ts") <= F.lit(until).cast("timestamp")))
    return d.where(at_least(F.col("level"), min_level)) if min_level else d


def filter_timelines(timelines: DataFrame, trace: str | None = None, only_failed: bool = False, top: int | None = None) -> DataFrame:
    """top: the heaviest by errors, then duration.  The given order is kept where there are no more than that."""
    d = timelines
    if trace:
        d = d.where(F.col("corr_key").contains(trace))
    if only_failed:
        d = d.where("is_failed")
    if top:
        d = d.orderBy(F.desc("error_count"), F.desc(F.coalesce("duration_ms", F.lit(0))), F.col("start").asc_nulls_last(), "first_seq", "corr_kind", "corr_key").limit(top)
    return d


def recognised(events: DataFrame) -> bool:
    """Whether any line was more than unparsed text."""
    return bool(events.where("kind <> 'UNPARSED'").limit(1).count())
