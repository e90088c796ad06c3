"""Columns that every stage asks of an event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .levels import is_error, level_order
from .mining import http_summary
from .stacks import header


def default_kind(kind: Column, exception: Column, http: Column) -> Column:
    return F.coalesce(kind, F.when(exception.isNotNull(), "EXCEPTION").when(http["status"].isNotNull(), "HTTP_RESPONSE").when(http.isNotNull(), "HTTP_REQUEST").otherwise("LOG"))


def with_derived(events: DataFrame) -> DataFrame:
    """level_ord, is_error, search_text (what rules look at) and summary, each computed once."""
    chain, http, message = F.col("exception"), F.col("http"), F.coalesce("message", F.lit(""))
    calls = http_summary(http)
    search = F.concat(message, F.coalesce(F.array_join(F.transform(chain, lambda x: F.concat(F.lit("\n"), header(x))), ""), F.lit("")), F.coalesce(F.concat(F.lit("\n"), calls), F.lit("")))
    return events.select(
        "*",
        level_order(F.col("level")).alias("level_ord"),
        is_error(F.col("level"), chain, http).alias("is_error"),
        search.alias("search_text"),
        F.coalesce(F.nullif(message, F.lit("")), F.nullif(calls, F.lit("")), header(F.get(chain, 0)), F.lit("")).alias("summary"),
    )
