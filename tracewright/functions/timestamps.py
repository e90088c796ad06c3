"""Timestamps of log lines: every shape is recognised by its regex first, then read as one ISO text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .let import let

TIME = r"\d{2}:\d{2}:\d{2}(?:\.\d{1,9})?"


def parse_timestamp(raw: Column, zone: str = "UTC", day: str = "1970-01-01") -> Column:
    """zone: of shapes without an offset.  day: of shapes without a date (its year, of those without a year)."""
    return let(F.regexp_replace(F.trim(raw), r"^(.*:.*),(\d[^,]*)$", "$1.$2"), lambda s: _parse(s, zone, day))  # a comma before fractions


def _parse(s: Column, zone: str, day: str) -> Column:
    offset = F.regexp_replace(s, r"([+-]\d{2})(\d{2})$", "$1:$2")
    at = lambda text: F.concat(text, F.lit(zone))
    iso = (
        F.when(s.rlike(rf"^\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}(?::\d{{2}}(?:\.\d{{1,9}})?)?(?:Z|[+-]\d{{2}}:?\d{{2}})$") & (F.length(s) >= 20), offset)
        .when(s.rlike(rf"^\d{{4}}-\d{{2}}-\d{{2}}[T ]{TIME}$"), at(s))
        .when(s.rlike(rf"^\d{{2}}\.\d{{2}}\.\d{{4}} {TIME}$"), at(F.regexp_replace(s, r"^(\d{2})\.(\d{2})\.(\d{4}) ", "$3-$2-$1T")))
        .when(s.rlike(rf"^\d{{4}}/\d{{2}}/\d{{2}} {TIME}$"), at(F.regexp_replace(s, r"^(\d{4})/(\d{2})/(\d{2}) ", "$1-$2-$3T")))
        .when(s.rlike(rf"^{TIME}$"), at(F.concat(F.lit(day + "T"), s)))
    )
    clf = F.when(s.rlike(r"^\d{2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4}$"), s)
    syslog = F.when(s.rlike(r"^[A-Za-z]{3} [ \d]\d \d{2}:\d{2}:\d{2}$"), F.concat(F.lit(day[:4] + " "), F.initcap(F.regexp_replace(s, " +", " ")), F.lit(" " + zone)))
    return F.coalesce(
        F.when(s.rlike(r"^\d{13}$"), F.timestamp_millis(s.try_cast("long"))),
        F.when(s.rlike(r"^\d{10}$"), F.timestamp_seconds(s.try_cast("long"))),
        F.try_to_timestamp(iso),
        F.try_to_timestamp(clf, F.lit("dd/MMM/yyyy:HH:mm:ss xx")),
        F.try_to_timestamp(syslog, F.lit("yyyy MMM d HH:mm:ss VV")),
    )
