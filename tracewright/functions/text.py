"""Small text helpers of reports and scoring."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shortened(text: Column, most: int) -> Column:
    """At most `most` characters, the last three being dots if anything went."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 3)), F.lit("..."))).otherwise(text)


def one_line(text: Column, most: int = 220) -> Column:
    return shortened(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), most)


def short_logger(name: Column, most: int = 26) -> Column:
    """Long dotted names keep the initials of their packages."""
    parts = F.split(name, r"\.")
    short = F.array_join(F.concat(F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.left(p, F.lit(1))), F.array(F.element_at(parts, -1))), ".")
    return F.when((F.length(name) <= most) | ~name.contains("."), name).otherwise(short)


def format_duration(ms: Column) -> Column:
    return (
        F.when(ms < 1000, F.concat(ms.cast("string"), F.lit(" ms")))
        .when(ms < 60_000, F.format_string("%.1f s", ms / F.lit(1000.0)))
        .otherwise(F.concat(F.floor(ms / 60_000).cast("string"), F.lit(" min "), F.floor(ms % 60_000 / 1000).cast("string"), F.lit(" s")))
    )


def nonblank(text: Column) -> Column:
    """Trimmed, blank becoming null."""
    return F.nullif(F.trim(text), F.lit(""))
