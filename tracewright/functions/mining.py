"""What a message's text tells: ids, durations, HTTP calls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import HTTP
from .let import let

#: Key names by id, all lower-case.
ID_KEYS = {
    "trace_id": ["traceid", "trace_id", "trace-id", "x-b3-traceid", "x-trace-id", "traceparent"],
    "span_id": ["spanid", "span_id", "span-id", "x-b3-spanid"],
    "session_id": ["sessionid", "session_id", "session-id", "jsessionid", "sid"],
    "request_id": ["requestid", "request_id", "request-id", "x-request-id", "correlationid", "correlation_id", "correlation-id", "x-correlation-id", "cid"],
    "user_id": ["userid", "user_id", "user-id", "username", "principal"],
}
#: The patterns of pairs, durations and calls.  Word edges are ASCII ones.
EDGE_L, EDGE_R = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
PAIR = r"""([A-Za-z][\w.\-]{1,40})\s*[=:]\s*("[^"]{1,200}"|'[^']{1,200}'|[^\s,;)\]}]{1,200})"""
DURATION = (
    rf"(?i)(?:took|elapsed|duration|latency|time)\s*[=:]?\s*(\d+(?:[.,]\d+)?)\s*(ms|s|sec|seconds|milliseconds){EDGE_R}"
    rf"|{EDGE_L}(\d{{1,9}})\s?(ms){EDGE_R}"
)
CALL = rf"""{EDGE_L}(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s+(https?://[^\s"']+|/[^\s"']*)"""
STATUS = rf"(?i)(?:status(?:code)?\s*[=:]\s*([1-5]\d{{2}})|HTTP/\d(?:\.\d)?\s+([1-5]\d{{2}})|{EDGE_L}responded\s+with\s+([1-5]\d{{2}}){EDGE_R})"


def group(text: Column, regex: str, index: int) -> Column:
    """A group of the first match; null where it is absent or empty."""
    return F.nullif(F.regexp_extract(text, regex, index), F.lit(""))


def pairs(text: Column) -> Column:
    """key=value pairs in order: keys lower-case, quotes gone, empty ones left out."""
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(PAIR), F.lit(1)).alias("k"), F.regexp_extract_all(text, F.lit(PAIR), F.lit(2)).alias("v"))
    clean = F.transform(both, lambda p: F.struct(F.lower(p["k"]).alias("k"), F.regexp_replace(F.trim(p["v"]), r"""^(?:"(.*)"|'(.*)')$""", "$1$2").alias("v")))
    return F.filter(clean, lambda p: (p["v"] != "") & (F.lower(p["v"]) != "null") & (p["v"] != "-"))


def last_id(found: Column, name: str) -> Column:
    """The last value under any key of an id; a traceparent gives its second part."""
    hit = F.try_element_at(F.filter(found, lambda p: p["k"].isin(ID_KEYS[name])), F.lit(-1))
    if name != "trace_id":
        return hit["v"]
    return let(hit, lambda h: F.when((h["k"] == "traceparent") & (F.size(F.split(h["v"], "-")) >= 3), F.get(F.split(h["v"], "-"), 1)).otherwise(h["v"]))


def duration_ms(text: Column) -> Column:
    number = F.coalesce(group(text, DURATION, 1), group(text, DURATION, 3))
    unit = F.lower(F.coalesce(group(text, DURATION, 2), group(text, DURATION, 4)))
    value = F.replace(number, F.lit(","), F.lit(".")).try_cast("double")
    return F.floor(F.when(unit.startswith("m"), value).otherwise(value * 1000) + 0.5).cast("long")


def http_struct(**parts: Column) -> Column:
    """An HTTP exchange; what is not given is null."""
    kinds = {"status": "int", "duration_ms": "bigint", "headers": "map<string,string>"}
    names = ["direction", "method", "url", "host", "status", "status_text", "duration_ms", "headers", "body"]
    return F.struct(*[parts.get(n, F.lit(None)).cast(kinds.get(n, "string")).alias(n) for n in names]).cast(HTTP)


def inline_http(text: Column) -> Column:
    """A call or a status named in a message; null if neither is."""
    parts = F.struct(group(text, CALL, 1).alias("method"), group(text, CALL, 2).alias("url"), F.coalesce(*[group(text, STATUS, i) for i in (1, 2, 3)]).alias("status"), duration_ms(text).alias("ms"))

    def found(p: Column) -> Column:
        out = F.coalesce(p["url"].startswith("http"), F.lit(False))
        host = F.when(out, F.try_parse_url(p["url"], F.lit("HOST")))
        made = http_struct(direction=F.when(out, "OUTBOUND").otherwise("UNKNOWN"), method=p["method"], url=p["url"], host=host, status=p["status"].try_cast("int"), duration_ms=p["ms"])
        return F.when(p["method"].isNotNull() | p["status"].isNotNull(), made)

    return let(parts, found)


def http_summary(http: Column) -> Column:
    text = F.concat(
        F.coalesce(F.concat(http["method"], F.lit(" ")), F.lit("")),
        F.coalesce(http["url"], F.lit("")),
        F.coalesce(F.concat(F.lit(" -> "), http["status"].cast("string")), F.lit("")),
        F.when(http["status"].isNotNull() & (F.trim(http["status_text"]) != ""), F.concat(F.lit(" "), http["status_text"])).otherwise(""),
        F.coalesce(F.concat(F.lit(" ("), http["duration_ms"].cast("string"), F.lit(" ms)")), F.lit("")),
    )
    return F.when(http.isNotNull(), F.trim(text))
