"""The whole analysis: events to timelines, hits and causes.  Everything stays lazy until a report asks for it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.levels import is_error
from ..operators.correlate import correlate
from ..operators.filters import filter_events
from ..operators.records import cut_records, parse_lines
from ..operators.rootcause import root_causes
from ..operators.timeline import build_entries, timelines
from ..rules.compile import apply_rules, rule_hits
from ..rules.model import Rule, load_rules
from ..sources.files import from_files, from_text


#: Lines of a file that one task puts together, unless the settings say otherwise.
FILE_BLOCK = 200_000


@dataclass(frozen=True)
class Analysis:
    events: DataFrame
    entries: DataFrame  # with annotations and rule hits
    timelines: DataFrame
    hits: DataFrame
    causes: DataFrame
    summary: DataFrame
    warnings: DataFrame | None = None


def event_summary(events: DataFrame) -> DataFrame:
    """One row: totals of events, errors, warnings (errors apart) and exceptions."""
    bad = is_error(F.col("level"), F.col("exception"), F.col("http"))
    return events.agg(
        F.count("*").alias("total_events"),
        F.count_if(bad).alias("error_events"),
        F.count_if((F.col("level") == "WARN") & ~bad).alias("warning_events"),
        F.count_if(F.col("exception").isNotNull()).alias("exception_events"),
    )


def analyze_events(events: DataFrame, config: Config = Config(), rules: list[Rule] | None = None, warnings: DataFrame | None = None, analyzer: Callable[..., DataFrame] = root_causes) -> Analysis:
    """analyzer(entries with hits, rules, settings) gives the causes; another one may be put in."""
    rules = load_rules(config.rules.files, config.rules.builtin) if rules is None else rules
    # read by every table below; kept, so that parsing and windows run once and later plans stay small
    events = events.persist(StorageLevel.MEMORY_AND_DISK)
    entries = apply_rules(build_entries(correlate(events, config.correlation), config.timeline), rules, config.timeline.block_entries).persist(StorageLevel.MEMORY_AND_DISK)
    spans = timelines(entries)
    summary = event_summary(events).crossJoin(spans.agg(F.count("*").alias("timelines"), F.count_if("is_failed").alias("failed_timelines")))  # one row each
    return Analysis(events, entries, spans, rule_hits(entries, rules), analyzer(entries, rules, config.analysis), summary, warnings)


def analyze_lines(lines: DataFrame, config: Config = Config(), rules: list[Rule] | None = None, warnings: DataFrame | None = None, since: str | datetime | None = None, until: str | datetime | None = None, min_level: str | None = None) -> Analysis:
    events = filter_events(parse_lines(lines, config.parse), since, until, min_level)
    cut = cut_records(lines, config.parse)
    return analyze_events(events, config, rules, warnings.unionByName(cut) if warnings is not None else cut)


def analyze_text(spark: SparkSession, text: str, config: Config = Config(), name: str = "snippet", **filters: str | datetime | None) -> Analysis:
    return analyze_lines(from_text(spark, text, name), config, **filters)


def analyze_files(spark: SparkSession, paths: list[str], config: Config = Config(), **filters: str | datetime | None) -> Analysis:
    lines, warnings = from_files(spark, paths, config.parse.charset)
    if not config.parse.block_lines:  # else one task would put a whole file's records together
        config = replace(config, parse=replace(config.parse, block_lines=FILE_BLOCK))
    return analyze_lines(lines, config, warnings=warnings, **filters)
