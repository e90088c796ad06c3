"""Raw HTTP requests and responses in a log: first line, headers, body."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.let import let
from ..functions.mining import http_struct

#: The first lines of dumps, and headers.
REQUEST = r"^(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS|TRACE)\s+(\S+)\s+HTTP/(\d(?:\.\d)?)\s*$"
STATUS = r"^HTTP/(\d(?:\.\d)?)\s+([1-5]\d{2})(?:\s+(.*))?$"
HEADER = r"^([A-Za-z][A-Za-z0-9\-_]*):\s*(.*)$"


def is_dump_start(line: Column) -> Column:
    s = F.trim(line)
    return s.rlike(REQUEST) | s.rlike(STATUS)


def headers(block: Column) -> Column:
    """array<struct<name,value>> in the order of the lines."""
    top = F.slice(block, 2, F.greatest(_body_at(block) - 2, F.lit(0)))
    return F.transform(top, lambda x: F.struct(F.regexp_extract(F.trim(x), HEADER, 1).alias("name"), F.regexp_extract(F.trim(x), HEADER, 2).alias("value")))


def _body_at(block: Column) -> Column:
    """1-based place of the first line after the first that is no header; one past the end if all are."""
    other = F.filter(F.sequence(F.lit(2), F.size(block) + 1), lambda i: F.coalesce(_ends(F.get(block, i - 1)), F.lit(True)))
    return F.get(other, 0)


def _ends(line: Column) -> Column:
    return (F.trim(line) == "") | F.lower(line).startswith("body:") | ~F.trim(line).rlike(HEADER)


def parse_dump(block: Column) -> Column:
    parts = F.struct(F.trim(F.get(block, 0)).alias("first"), _body_at(block).alias("at"), headers(block).alias("headers"))
    return let(parts, lambda p: _dump(block, p["first"], p["at"], p["headers"]))


def _dump(block: Column, first: Column, at: Column, found: Column) -> Column:
    request, url = first.rlike(REQUEST), F.regexp_extract(first, REQUEST, 2)
    turn = F.get(block, at - 1)
    rest = F.slice(block, at + 1, F.greatest(F.size(block) - at, F.lit(0)))
    said = F.trim(F.substr(turn, F.lit(6)))
    lead = F.when(turn.isNull() | (F.trim(turn) == ""), F.array().cast("array<string>")).when(F.lower(turn).startswith("body:"), F.when(said != "", F.array(said)).otherwise(F.array().cast("array<string>"))).otherwise(F.array(turn))
    # lines join with a line end, blank ones at the start not counting
    body = F.regexp_replace(F.array_join(F.concat(lead, rest), "\n"), r"^\n+", "")
    # of equal names the last header counts
    last = F.filter(found, lambda h, i: ~F.exists(F.slice(found, i + 2, F.size(found)), lambda o: o["name"] == h["name"]))
    host = F.try_element_at(F.filter(found, lambda h: F.lower(h["name"]) == "host"), F.lit(-1))["value"]
    return http_struct(
        direction=F.when(request, F.when(url.startswith("http"), "OUTBOUND").otherwise("INBOUND")).otherwise("UNKNOWN"),
        method=F.when(request, F.regexp_extract(first, REQUEST, 1)),
        url=F.when(request, url),
        host=host,
        status=F.when(~request, F.regexp_extract(first, STATUS, 2).try_cast("int")),
        status_text=F.when(~request, F.nullif(F.regexp_extract(first, STATUS, 3), F.lit(""))),
        headers=F.map_from_entries(last),
        body=F.nullif(body, F.lit("")),
    )
