"""Structured JSON log lines, with the field names of the common encoders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.let import let
from ..functions.levels import parse_level
from ..functions.mining import http_struct
from ..functions.stacks import exception_chain
from ..functions.text import nonblank
from ..functions.timestamps import parse_timestamp
from ..schema import LINK

#: Names under which encoders write a field, in order of preference.
NAMES = {
    "ts": ["@timestamp", "timestamp", "time", "ts", "eventTime", "event_time", "date", "@time"],
    "level": ["level", "severity", "log.level", "loglevel", "levelStr", "level_name", "priority", "log_level"],
    "message": ["message", "msg", "@message", "short_message", "text", "log", "body", "event"],
    "logger": ["logger_name", "loggerName", "logger", "log.logger", "category", "class", "source", "log.origin.file.name"],
    "thread": ["thread_name", "threadName", "thread", "log.origin.thread.name", "process.thread.name"],
    "trace_id": ["traceId", "trace_id", "traceID", "trace.id", "dd.trace_id", "X-B3-TraceId", "traceid"],
    "span_id": ["spanId", "span_id", "spanID", "span.id", "dd.span_id", "X-B3-SpanId"],
    "session_id": ["sessionId", "session_id", "session.id", "sid", "JSESSIONID"],
    "request_id": ["requestId", "request_id", "correlationId", "correlation_id", "x-request-id", "http.request.id"],
    "user_id": ["userId", "user_id", "user.id", "user.name", "principal", "username"],
    "service": ["service", "service.name", "serviceName", "application", "app", "appName", "application_name", "spring.application.name", "kubernetes.container_name"],
    "stack": ["stack_trace", "stackTrace", "stacktrace", "exception", "throwable", "error.stack_trace", "error.stacktrace", "exception.stacktrace", "err", "error"],
    "method": ["http.request.method", "method", "httpMethod", "http_method", "request.method", "verb"],
    "url": ["url.full", "url.path", "uri", "url", "path", "requestURI", "request.uri", "http.url", "request_uri"],
    "status": ["http.response.status_code", "status", "statusCode", "status_code", "response.status", "responseStatus", "http_status"],
    "duration": ["event.duration", "duration", "durationMs", "duration_ms", "elapsed", "responseTime", "took"],
    "host": ["url.domain", "host", "hostname", "server", "target"],
}
CONTEXTS = ["mdc", "contextMap", "context", "labels", "extra", "fields"]
CONSUMED = [
    "@timestamp", "timestamp", "time", "ts", "level", "severity", "message", "msg", "logger_name", "loggerName", "logger", "thread_name",
    "threadName", "thread", "traceId", "trace_id", "spanId", "span_id", "stack_trace", "stackTrace", "exception", "throwable", "mdc",
    "contextMap", "@version", "sessionId", "requestId",
]
IDS = ["trace_id", "span_id", "session_id", "request_id", "user_id"]
ENTRIES = "array<struct<key:string,text:string>>"


def json_object(line: Column) -> Column:
    """The line as a variant if it is one JSON object, else null.  Twice the same key is no valid object here."""
    s = F.trim(line)
    return F.when((F.length(s) > 2) & s.startswith("{") & s.endswith("}"), F.try_parse_json(s))


def _children(v: Column) -> Column:
    return F.map_entries(v.try_cast("map<string,variant>"))


def scalars(obj: Column) -> Column:
    """Scalars of an object to three levels below the top, keys joined by dots; nearer ones first, each key once."""

    def told(entries: Column) -> Column:
        """With each entry its text, and its type if the text may be that of an object or a list."""
        kind = lambda e: F.when(e["text"].startswith("{") | e["text"].startswith("["), F.schema_of_variant(e["value"])).otherwise("")
        every = F.transform(entries, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), e["value"].try_cast("string").alias("text")))
        return F.transform(every, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), e["text"].alias("text"), F.substr(F.coalesce(kind(e), F.lit("")), F.lit(1), F.lit(6)).alias("kind")))

    def below(level: Column) -> Column:
        objects = F.filter(level, lambda e: e["kind"] == "OBJECT")
        return told(F.flatten(F.transform(objects, lambda e: F.transform(_children(e["value"]), lambda c: F.struct(F.concat(e["key"], F.lit("."), c["key"]).alias("key"), c["value"].alias("value"))))))

    def texts(level: Column) -> Column:
        plain = F.filter(level, lambda e: (e["kind"] != "OBJECT") & ~e["kind"].startswith("ARRAY"))
        return F.transform(plain, lambda e: F.struct(e["key"].alias("key"), e["text"].alias("text"))).cast(ENTRIES)

    def joined(*levels: Column) -> Column:
        return F.concat(*[F.coalesce(texts(x), F.array().cast(ENTRIES)) for x in levels])

    def once(every: Column) -> Column:
        keys = F.transform(every, lambda e: e["key"])
        return F.map_from_entries(F.when(F.size(F.array_distinct(keys)) == F.size(every), every).otherwise(F.filter(every, lambda e, i: F.array_position(keys, e["key"]) == i + 1)))

    # each level is worked out once; most records end with the second
    deeper = lambda a, b: let(below(b), lambda c: let(below(c), lambda d: joined(a, b, c, d)))
    nested = lambda x: F.exists(x, lambda e: e["kind"] == "OBJECT")
    every = let(told(_children(obj)), lambda a: F.when(nested(a), let(below(a), lambda b: F.when(nested(b), deeper(a, b)).otherwise(joined(a, b)))).otherwise(joined(a)))
    return let(F.coalesce(every, F.array().cast(ENTRIES)), once)


def first_text(values: Column, names: list[str]) -> Column:
    """The first value that is not blank, as it stands."""
    return F.get(F.filter(F.transform(F.array(*[F.lit(n) for n in names]), lambda n: F.try_element_at(values, n)), lambda t: F.trim(t) != ""), F.lit(0))


def context(values: Column) -> Column:
    """Scalars directly below the context objects, under their bare keys, in the order of the objects."""
    out = F.array().cast(ENTRIES)
    entries = F.map_entries(values)
    for name in CONTEXTS:
        inner = F.filter(entries, lambda e: e["key"].startswith(name + ".") & ~F.substr(e["key"], F.lit(len(name) + 2)).contains("."))
        out = F.concat(out, F.transform(inner, lambda e: F.struct(F.substr(e["key"], F.lit(len(name) + 2)).alias("key"), e["value"].alias("text"))).cast(ENTRIES))
    return out


def json_time(values: Column, zone: str, day: str) -> Column:
    """The first of the time fields that can be read."""
    get = lambda key: F.try_element_at(values, F.lit(key))
    number = lambda c: F.when(c.rlike(r"^-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?$"), c.try_cast("double").try_cast("long"))

    def when(text: Column) -> Column:
        counted = lambda n: F.when(n > 100_000_000_000, F.timestamp_millis(n)).otherwise(F.timestamp_seconds(n))
        return F.coalesce(let(number(text), counted), parse_timestamp(text, zone, day))

    instant = F.timestamp_micros(get("instant.epochSecond").try_cast("long") * 1_000_000 + F.floor(F.coalesce(get("instant.nanoOfSecond").try_cast("long"), F.lit(0)) / 1000))
    return F.coalesce(instant, F.get(F.filter(F.transform(F.array(*[get(n) for n in NAMES["ts"]]), when), lambda t: t.isNotNull()), F.lit(0)))


def json_fields(values: Column, said: Column, zone: str, day: str) -> dict[str, Column]:
    """Event columns of a JSON record, from its scalars and what context() makes of them."""
    text = {name: first_text(values, keys) for name, keys in NAMES.items()}
    out = {"ts": json_time(values, zone, day), "level": parse_level(text["level"]), "message": F.coalesce(text["message"], F.lit(""))}
    for name in ("logger", "thread", "service"):
        out[name] = nonblank(text[name])
    for name in IDS:  # a context's ids come before the record's own
        known = [k.lower() for k in NAMES[name]]
        out[name] = nonblank(F.coalesce(F.try_element_at(F.filter(said, lambda e: F.lower(e["key"]).isin(known)), F.lit(-1))["text"], text[name]))

    stacks = [first_text(values, [k, *(f"{k}.{s}" for s in ("stacktrace", "stack_trace", "stackTrace", "trace"))]) for k in NAMES["stack"]]
    kinds = [first_text(values, [f"{k}.{s}" for s in ("exception_class", "class", "type", "name")]) for k in NAMES["stack"]]
    words = [first_text(values, [f"{k}.{s}" for s in ("exception_message", "message", "msg")]) for k in NAMES["stack"]]
    kind, word = F.coalesce(*kinds), F.coalesce(*words)
    bare = F.array(F.struct(kind.alias("type"), word.alias("message"), F.array().alias("frames"), F.lit(0).alias("omitted"), F.array().alias("suppressed"))).cast(f"array<{LINK}>")
    out["exception"] = F.coalesce(exception_chain(F.split(F.coalesce(*stacks), r"\r\n|\r|\n")), F.when(kind.isNotNull() | word.isNotNull(), bare))

    url = text["url"]
    call = http_struct(
        direction=F.when(F.coalesce(url.startswith("http"), F.lit(False)), "OUTBOUND").otherwise("INBOUND"),
        method=text["method"],
        url=url,
        host=text["host"],
        status=F.trim(text["status"]).try_cast("int"),
        duration_ms=F.replace(text["duration"], F.lit(","), F.lit(".")).try_cast("double").try_cast("long"),
    )
    out["http"] = F.when(text["method"].isNotNull() | url.isNotNull() | text["status"].isNotNull(), call)
    own = F.map_filter(values, lambda k, v: ~k.isin(CONSUMED) & (F.trim(F.coalesce(v, F.lit("null"))) != "") & (F.length(F.coalesce(v, F.lit("null"))) <= 500))
    own = F.transform_values(own, lambda k, v: F.coalesce(v, F.lit("null")))
    bare_keys = F.filter(said, lambda e, i: (F.trim(e["text"]) != "") & ~F.map_contains_key(own, e["key"]) & ~F.exists(F.slice(said, i + 2, F.size(said)), lambda o: o["key"] == e["key"]))
    out["attributes"] = F.map_concat(own, F.map_from_entries(bare_keys))
    return out
