"""Fingerprints of events: equal ones are the same event said again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .mining import EDGE_L, EDGE_R
from .stacks import chain_fingerprint

#: Variable parts and what stands for them, in the order of replacement.
VARIABLE = [
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?", "<ts>"),
    (EDGE_L + r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}" + EDGE_R, "<uuid>"),
    (EDGE_L + r"[0-9a-fA-F]{8,}" + EDGE_R, "<hex>"),
    (r"\d+(?:[.,]\d+)?", "<n>"),
]


def normalize(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for regex, name in VARIABLE:
        out = F.regexp_replace(out, regex, name)
    return out


def fingerprint(level: Column, logger: Column, message: Column, exception: Column, http: Column, normalized: bool = True) -> Column:
    part = normalize if normalized else lambda c: F.coalesce(c, F.lit("null"))
    call = F.concat(F.lit("|"), F.coalesce(http["method"], F.lit("null")), F.lit(" "), part(http["url"]), F.lit(" -> "), F.coalesce(http["status"].cast("string"), F.lit("null")))
    return F.concat(
        level,
        F.lit("|"),
        F.coalesce(logger, F.lit("")),
        F.lit("|"),
        part(message),
        F.coalesce(F.concat(F.lit("|"), chain_fingerprint(exception)), F.lit("")),
        F.when(http.isNotNull(), call).otherwise(""),
    )
