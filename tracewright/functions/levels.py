"""Log levels and their order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import LEVELS

#: Spellings of levels.
SPELLINGS = {
    "TRACE": ["TRACE", "FINEST", "VERBOSE"],
    "DEBUG": ["DEBUG", "FINE", "FINER"],
    "INFO": ["INFO", "INFORMATION", "NOTICE", "CONFIG"],
    "WARN": ["WARN", "WARNING"],
    "ERROR": ["ERROR", "SEVERE", "ERR"],
    "FATAL": ["FATAL", "CRIT", "CRITICAL", "EMERG", "ALERT", "PANIC"],
}


def parse_level(text: Column) -> Column:
    known = F.create_map(*[F.lit(x) for level, words in SPELLINGS.items() for w in words for x in (w, level)])
    return F.coalesce(F.try_element_at(known, F.upper(F.trim(text))), F.lit("UNKNOWN"))


def level_order(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level).cast("int") - 1


def at_least(level: Column, least: str | None) -> Column:
    """No threshold passes everything; an unknown level passes no threshold."""
    if least in (None, "", "UNKNOWN"):
        return F.lit(True)
    return level_order(level) >= LEVELS.index(least)


def is_error(level: Column, exception: Column, http: Column) -> Column:
    return level.isin("ERROR", "FATAL") | (F.coalesce(F.size(exception), F.lit(0)) > 0) | F.coalesce(http["status"] >= 500, F.lit(False))
