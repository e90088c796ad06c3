"""Incident timelines: entries in time order, repeats merged, annotated, offsets and HTTP pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Timeline
from ..functions.events import with_derived
from ..functions.fingerprint import fingerprint
from ..functions.mining import http_summary
from ..functions.stacks import simple_type
from ..functions.text import format_duration
from .correlate import by_time, in_time
from .scan import Running, checkpointed, cuts, running

GROUP = ["corr_kind", "corr_key"]
NOTE = "struct<type:string,label:string,rule:string>"
NOTES = f"array<{NOTE}>"


def note(kind: str, label: Column, rule: str = "builtin") -> Column:
    return F.struct(F.lit(kind).alias("type"), label.alias("label"), F.lit(rule).alias("rule")).cast(NOTE)


def notes(*found: tuple[Column, Column]) -> Column:
    """Annotations whose condition holds, in this order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(when, F.lit(False)), what) for when, what in found])).cast(NOTES)


def first_of_each(every: Column) -> Column:
    """Of annotations with the same type and label the first."""
    return F.filter(every, lambda a, i: ~F.exists(F.slice(every, 1, i), lambda o: (o["type"] == a["type"]) & o["label"].eqNullSafe(a["label"])))


def by_entry(entries: int) -> Column | None:
    return F.floor((F.col("entry_no") - 1) / entries) if entries else None


def merge_repeats(events: DataFrame, settings: Timeline = Timeline()) -> DataFrame:
    """Entries: the first event of every run of equal neighbours, with repeat_count and last_repeat_at."""
    block = by_time(settings.block_seconds)
    if settings.dedup:
        d = events.withColumn("fp", fingerprint(F.col("level"), F.col("logger"), F.col("message"), F.col("exception"), F.col("http"), settings.dedup_normalize))
        other = lambda now, before: ~now["fp"].eqNullSafe(before["fp"]) | F.coalesce(F.abs(now["us"] - before["us"]) > settings.dedup_window_seconds * 1_000_000, F.lit(False))
        d = cuts(d, GROUP, in_time(), other, {"fp": F.col("fp"), "us": F.unix_micros("ts")}, block, "entry_no").withColumn("entry_no", (F.col("entry_no") + 1).cast("int"))
        place = F.struct(F.col("ts").isNull(), "ts", "seq")
        d = d.groupBy(*GROUP, "entry_no").agg(
            F.min_by(F.struct(*[c for c in events.columns if c not in GROUP]), place).alias("e"),
            F.count("*").cast("int").alias("repeat_count"),
            F.max_by("ts", place).alias("at"),
        )
        return d.select(*GROUP, "entry_no", "e.*", "repeat_count", F.when(F.col("repeat_count") > 1, F.col("at")).alias("last_repeat_at"))
    d = running(events, GROUP, in_time(), {"entry_no": Running("total", F.lit(1))}, block).withColumn("entry_no", F.col("entry_no").cast("int"))
    return d.withColumns({"repeat_count": F.lit(1), "last_repeat_at": F.lit(None).cast("timestamp")})


def builtin_notes(settings: Timeline) -> Column:
    chain, http = F.col("exception"), F.col("http")
    thrown, status = F.coalesce(F.size(chain) > 0, F.lit(False)) & chain.isNotNull(), F.col("http.status")
    attribute = F.try_element_at("attributes", F.lit("durationMs")).try_cast("long")
    slow = F.coalesce(F.col("http.duration_ms") >= settings.slow_ms, F.lit(False))
    took = lambda ms: F.concat(F.lit("took "), ms.cast("string"), F.lit(" ms"))
    code = F.concat(F.lit("HTTP "), status.cast("string"))
    return notes(
        (thrown, note("EXCEPTION", simple_type(F.get(chain, 0)["type"]))),
        (thrown & (F.size(chain) > 1), note("EXCEPTION", F.concat(F.lit("root: "), simple_type(F.element_at(chain, -1)["type"])))),
        (~thrown & F.col("level").isin("ERROR", "FATAL"), note("ERROR", F.lit("error"))),
        (~thrown & (F.col("level") == "WARN"), note("WARNING", F.lit("warning"))),
        (F.coalesce(F.col("http.direction") == "OUTBOUND", F.lit(False)) | F.col("http.host").isNotNull() | F.coalesce(F.col("http.url").startswith("http"), F.lit(False)), note("EXTERNAL_CALL", http_summary(http))),
        (status >= 500, note("HTTP_SERVER_ERROR", code)),
        (status.between(400, 499), note("HTTP_CLIENT_ERROR", code)),
        (slow, note("SLOW", took(F.col("http.duration_ms")))),
        (~slow & (attribute >= settings.slow_ms), note("SLOW", took(attribute))),
    )


def offsets(entries: DataFrame, block: Column | None = None) -> DataFrame:
    """Adds since_start_ms and since_previous_ms; undated entries have neither and are passed over."""
    last = F.when(F.col("ts").isNotNull(), F.coalesce("last_repeat_at", "ts"))
    entries = running(entries, GROUP, [F.col("entry_no")], {"start_at": Running("first", F.col("ts")), "prior_at": Running("before", last)}, block)
    ms = lambda a, b: F.floor((F.unix_micros(a) - F.unix_micros(b)) / 1000).cast("long")
    return entries.withColumns({"since_start_ms": ms("ts", "start_at"), "since_previous_ms": ms("ts", "prior_at")}).drop("start_at", "prior_at")


def http_links(entries: DataFrame, block: Column | None = None) -> DataFrame:
    """Adds related_ids: a request and the next response of its timeline know each other."""
    answers = F.when(F.col("kind") == "HTTP_RESPONSE", F.col("entry_no"))
    d = running(entries, GROUP, [F.col("entry_no")], {"answer": Running("following", answers)}, block)
    d = d.withColumn("answer", F.when(F.col("kind") == "HTTP_REQUEST", F.col("answer")))
    if block is None:
        # requests that a response answers: those since the response before it
        asked = F.sum((F.col("kind") == "HTTP_RESPONSE").cast("int")).over(Window.partitionBy(*GROUP).orderBy("entry_no").rowsBetween(Window.unboundedPreceding, -1))
        d = d.withColumn("turn", F.coalesce(asked, F.lit(0)))
        d = d.withColumn("askers", F.collect_list(F.when(F.col("answer").isNotNull(), F.col("entry_no"))).over(Window.partitionBy(*GROUP, "turn").orderBy("entry_no"))).drop("turn")
    else:  # brought to the response by a join, as those since the last response may be the whole timeline
        d = checkpointed(d)
        asked = d.where("answer IS NOT NULL").groupBy(*GROUP, F.col("answer").alias("entry_no")).agg(F.array_sort(F.collect_list(F.col("entry_no"))).alias("askers"))
        d = d.join(asked, [*GROUP, "entry_no"], "left")
    askers = F.coalesce("askers", F.array().cast("array<int>"))
    ids = F.when(F.col("kind") == "HTTP_RESPONSE", askers).when(F.col("answer").isNotNull(), F.array("answer")).otherwise(F.array().cast("array<int>"))
    return d.withColumn("related_ids", F.transform(ids, lambda n: F.concat(F.lit("e"), n.cast("string")))).drop("answer", "askers")


def build_entries(correlated: DataFrame, settings: Timeline = Timeline()) -> DataFrame:
    """Entries of every timeline: entry_id, annotations, offsets, related ids and derived columns."""
    block = by_entry(settings.block_entries)
    d = offsets(merge_repeats(correlated, settings), block)
    d = http_links(d, block) if settings.link_http else d.withColumn("related_ids", F.array().cast("array<string>"))
    gap = F.col("since_previous_ms") >= settings.suspicious_gap_seconds * 1000
    extra = notes(
        (gap, note("SLOW", F.concat(F.lit("pause of "), format_duration(F.col("since_previous_ms")), F.lit(" before")))),
        (F.col("repeat_count") > 1, note("RETRY", F.concat(F.lit("repeats: "), F.col("repeat_count").cast("string")))),
    )
    d = d.withColumn("annotations", F.concat(builtin_notes(settings), extra)).withColumn("annotations", first_of_each(F.col("annotations")))
    return with_derived(d.withColumn("entry_id", F.concat(F.lit("e"), F.col("entry_no").cast("string"))))


def span_values() -> dict[str, Column]:
    """What a timeline's span and counts are, as aggregates over its entries; by groups or by windows."""
    place = F.when(F.col("ts").isNotNull(), F.col("entry_no"))
    end = F.coalesce("last_repeat_at", "ts")
    return {
        "start": F.min_by("ts", place),
        "end": F.max_by(end, F.when(end.isNotNull(), F.col("entry_no"))),
        "first_seq": F.min("seq"),
        "event_count": F.sum("repeat_count"),
        "entry_count": F.count("*"),
        "error_count": F.count_if("is_error"),
        "warning_count": F.count_if(F.col("level") == "WARN"),
        "first_error": F.min(F.when(F.col("is_error"), F.col("entry_no"))),
        "last_error": F.max(F.when(F.col("is_error"), F.col("entry_no"))),
    }


def duration_ms(start: Column, end: Column) -> Column:
    return F.floor((F.unix_micros(end) - F.unix_micros(start)) / 1000).cast("long")


def timelines(entries: DataFrame) -> DataFrame:
    """One row a timeline: span, counts and services."""
    services = F.array_sort(F.collect_list(F.when(F.col("service").isNotNull(), F.struct("entry_no", "service"))))
    out = entries.groupBy(*GROUP).agg(*[c.alias(n) for n, c in span_values().items()], F.array_distinct(F.transform(services, lambda s: s["service"])).alias("services"))
    return out.withColumns({"duration_ms": duration_ms(F.col("start"), F.col("end")), "is_failed": F.col("error_count") > 0})
