"""Probable root causes: candidates of rules, exceptions, triggers and cascades, weighed and ranked per timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Analysis
from ..functions.mining import http_summary
from ..functions.stacks import simple_type
from ..functions.text import one_line, shortened
from ..rules.model import Rule, in_order
from ..schema import RELIABILITY
from .scan import Running, running, whole
from .timeline import GROUP, by_entry, duration_ms, span_values

EVIDENCE = "struct<entry_id:string,ts:string,summary:string>"
CANDIDATE = f"struct<src:int,rule_no:int,title:string,description:string,category:string,source:string,rule:string,recommendation:string,raw:double,extra:array<{EVIDENCE}>>"
#: Packages that are not the application's own, where none is named.
FOREIGN = ["java.", "javax.", "jdk.", "sun.", "org.springframework.", "org.apache.", "io.netty.", "reactor.", "org.hibernate."]
TRIGGERS = ["TIMEOUT", "RETRY", "HTTP_SERVER_ERROR", "RESILIENCE"]


def _clamped(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def _evidence() -> Column:
    text = F.trim(F.regexp_replace(F.coalesce("summary", F.lit("")), r"[\r\n]+", " "))
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return F.struct(F.col("entry_id"), at.alias("ts"), shortened(text, 200).alias("summary")).cast(EVIDENCE)


def app_frame(link: Column, packages: tuple[str, ...]) -> Column:
    """The first frame of the application's own code, else the first frame."""

    def own(f: Column) -> Column:
        hit = F.lit(False)
        for p in packages or FOREIGN:
            hit = hit | F.coalesce(f["cls"].startswith(p), F.lit(False))
        return hit if packages else f["cls"].isNotNull() & ~hit

    return F.coalesce(F.get(F.filter(link["frames"], own), 0), F.get(link["frames"], 0))


def frame_text(f: Column) -> Column:
    place = F.concat(F.coalesce(f["file"], F.lit("Unknown Source")), F.coalesce(F.concat(F.lit(":"), f["line"].cast("string")), F.lit("")))
    return F.concat(f["cls"], F.lit("."), f["method"], F.lit("("), F.when(f["native"], "Native Method").otherwise(place), F.lit(")"))


def _candidate(src: int, title: Column, description: Column, category: Column, raw: Column, advice: Column, rule_no: Column | None = None, rule: Column | None = None, extra: Column | None = None) -> Column:
    return F.struct(
        F.lit(src).alias("src"),
        (rule_no if rule_no is not None else F.lit(0)).alias("rule_no"),
        title.alias("title"),
        description.alias("description"),
        category.alias("category"),
        F.lit("RULE" if src == 0 else "HEURISTIC").alias("source"),
        (rule if rule is not None else F.lit(None).cast("string")).alias("rule"),
        advice.alias("recommendation"),
        _clamped(raw).alias("raw"),
        (extra if extra is not None else F.array()).alias("extra"),
    ).cast(CANDIDATE)


def candidates(ruled: DataFrame, rules: list[Rule], settings: Analysis = Analysis(), spans: bool = False) -> DataFrame:
    """One row a candidate, of timelines that have an error.

    spans: with a struct `span` of the timeline's span and counts, from the same partitioning, and one row without a candidate for
    every timeline.
    """
    has = F.coalesce(F.size("exception") > 0, F.lit(False)) & F.col("exception").isNotNull()
    marked = F.exists("annotations", lambda a: a["type"].isin(TRIGGERS))
    d = ruled.withColumn("ev", _evidence())
    d = running(d, GROUP, [F.col("entry_no")], {"prev_ev": Running("previous", F.col("ev"))}, by_entry(settings.block_entries))
    failed = F.when(F.col("is_error"), F.col("entry_no"))
    of_all = {
        "fe": F.min(failed),
        "fe_ev": F.min_by("ev", failed),
        "fe_text": F.min_by("summary", failed),
        "le_ev": F.max_by("ev", failed),
        "errors": F.count_if("is_error"),
        "thrown": F.min(F.when(has, F.col("entry_no"))),
    }
    of_span = {f"_span_{n}": c for n, c in span_values().items()} if spans else {}
    of_all |= of_span
    d = whole(d, GROUP, of_all, bool(settings.block_entries)).where(F.col("fe").isNotNull())
    near = F.when(marked & F.col("entry_no").between(F.col("fe") - 10, F.col("fe") - 1), F.col("entry_no"))
    d = whole(d, GROUP, {"trigger": F.max(near)}, bool(settings.block_entries))

    table = [r for r in in_order(rules)]
    spec = F.array(
        *[
            F.struct(
                *[F.lit(getattr(r.cause, n, None)).cast("string").alias(n) for n in ("title", "description", "category", "recommendation")],
                F.lit(r.cause.confidence if r.cause else 0.0).alias("confidence"),
                F.lit(r.name).alias("name"),
                F.lit(min(0.05, r.priority / 2000.0)).alias("bonus"),
            )
            for r in table
        ]
    )

    def of_rule(h: Column) -> Column:
        s = F.get(spec, h)
        raw = s["confidence"] + F.when(F.col("entry_no") == F.col("fe"), 0.07).otherwise(0.0) - F.when(F.col("is_error"), 0.0).otherwise(0.15) + s["bonus"]
        return F.when(s["title"].isNotNull(), _candidate(0, s["title"], s["description"], s["category"], raw, s["recommendation"], h, s["name"]))

    ruled_ones = F.array_compact(F.transform("hits", of_rule)) if table else F.array().cast(f"array<{CANDIDATE}>")

    outer, root = F.get("exception", F.lit(0)), F.element_at("exception", -1)
    wrapped = F.size("exception") > 1
    frame = F.coalesce(app_frame(root, settings.application_packages), F.when(wrapped, app_frame(outer, settings.application_packages)))
    said = F.coalesce(F.trim(root["message"]) != "", F.lit(False))
    chain = F.array_join(F.transform("exception", lambda x: simple_type(x["type"])), " -> ")
    description = F.trim(
        F.concat(
            F.when(wrapped, F.concat(F.lit("Exception chain: "), chain, F.lit(". "))).otherwise(""),
            F.when(said, F.concat(F.lit("Message: "), one_line(root["message"]), F.lit(". "))).otherwise(""),
            F.when(frame.isNotNull(), F.concat(F.lit("Place in code: "), frame_text(frame), F.lit("."))).otherwise(""),
        )
    )
    raw = F.lit(0.6) + F.when(wrapped, 0.1).otherwise(0.0) + F.when(frame.isNotNull(), 0.1).otherwise(0.0) + F.when(F.col("entry_no") == F.col("fe"), 0.05).otherwise(0.0)
    title = F.concat(simple_type(root["type"]), F.when(said, F.concat(F.lit(": "), one_line(root["message"]))).otherwise(""))
    advice = F.when(frame.isNull(), "Read the stack trace; its top frame is where the error arose.").otherwise(F.concat(F.lit("Begin with "), frame_text(frame), F.lit(", the nearest frame of the application.")))
    of_exception = F.when(has & (F.col("entry_no") == F.coalesce("thrown", "fe")), _candidate(1, title, description, F.lit("exception"), raw, advice))

    every = [ruled_ones, F.array_compact(F.array(of_exception))]
    if settings.detect_cascade:
        kind = lambda t: F.exists("annotations", lambda a: a["type"] == t)
        status = F.col("http.status")
        words = (
            F.when(kind("TIMEOUT"), F.concat(F.lit("Timeout before the failure: "), one_line(F.col("summary"))))
            .when(F.coalesce(status >= 400, F.lit(False)), F.concat(F.lit("Failed external call: "), http_summary(F.col("http"))))
            .when(kind("RETRY"), F.concat(F.lit("Retries before the failure: "), one_line(F.col("summary"))))
            .otherwise(F.concat(F.lit("Triggering event: "), one_line(F.col("summary"))))
        )
        raw = F.lit(0.55) + F.when(kind("TIMEOUT"), 0.15).otherwise(0.0) + F.when(kind("RETRY"), 0.05).otherwise(0.0) + F.when(F.coalesce(status >= 500, F.lit(False)), 0.1).otherwise(0.0)
        of_trigger = F.when(
            F.col("entry_no") == F.col("trigger"),
            _candidate(2, words, F.lit("The error followed this event, which most likely set it off."), F.lit("cascade"), raw, F.lit("Check the external system or resource of this step."), extra=F.array("fe_ev")),
        )
        of_cascade = F.when(
            (F.col("entry_no") == F.col("fe")) & (F.col("errors") > 1),
            _candidate(
                3,
                F.concat(F.lit("Cascade of errors: "), F.col("errors").cast("string"), F.lit(" failures in one chain")),
                F.concat(F.lit("First error: "), one_line(F.col("fe_text")), F.lit(". Later ones probably follow from it.")),
                F.lit("cascade"),
                F.lit(0.5),
                F.lit("Solve the first error; the others usually go with it."),
                extra=F.array("le_ev"),
            ),
        )
        every += [F.array_compact(F.array(of_trigger, of_cascade))]
    if spans:
        d = d.withColumn("span", F.struct(*[F.col(n).alias(n.removeprefix("_span_")) for n in of_span]))
        every.append(F.when(F.col("entry_no") == F.col("fe"), F.array(F.lit(None).cast(CANDIDATE))).otherwise(F.array().cast(f"array<{CANDIDATE}>")))
    kept = [*GROUP, *(["span"] if spans else []), "entry_no"]
    d = d.select(*kept, "entry_id", "ev", "prev_ev", F.explode(F.concat(*every)).alias("c"))
    extra = F.filter("c.extra", lambda e: e["entry_id"] != F.col("entry_id"))
    evidence = F.array_compact(F.concat(F.array("ev"), extra, F.array("prev_ev")))
    return d.select(*kept, "c.*", evidence.alias("evidence")).drop("extra")


def _ranked(c: DataFrame, settings: Analysis) -> DataFrame:
    # of one rule's hits on one entry the surer one counts, the earlier one of equals
    same = Window.partitionBy(*GROUP, "src", "rule", "entry_no").orderBy(F.desc("raw"), "rule_no")
    c = c.withColumn("nth", F.row_number().over(same)).where("nth = 1").drop("nth")
    reliability = F.element_at(F.create_map(*[F.lit(x) for pair in RELIABILITY.items() for x in pair]), F.col("corr_kind"))
    c = c.withColumn("confidence", F.col("raw") * (F.lit(0.85) + F.lit(0.15) * reliability)).where(F.col("src").isNull() | (F.col("confidence") >= settings.min_confidence))
    order = Window.partitionBy(*GROUP).orderBy(F.desc_nulls_last("raw"), "src", "entry_no", "rule_no")
    return c.withColumn("rank", F.row_number().over(order))


def root_causes(ruled: DataFrame, rules: list[Rule], settings: Analysis = Analysis()) -> DataFrame:
    """Ranked causes (rank 1 the probable one, then alternatives) with confidence scaled by how reliable the grouping is."""
    c = _ranked(candidates(ruled, rules, settings), settings)
    return c.where(F.col("rank") <= settings.max_alternatives + 1).drop("raw", "src", "rule_no")


def incidents(ruled: DataFrame, rules: list[Rule], settings: Analysis = Analysis()) -> DataFrame:
    """One row a failed timeline: its span and counts, and its probable cause, null where none is sure enough.

    Spans and causes are windows of one partitioning; entries are neither planned nor shuffled twice.
    """
    c = _ranked(candidates(ruled, rules, settings, spans=True), settings).where("rank = 1")
    span = lambda n: F.col(f"span.{n}")
    cause = ["entry_no", "title", "description", "category", "source", "rule", "recommendation", "confidence", "evidence"]
    has = F.col("src").isNotNull()  # the row without a candidate stands at the first error
    return c.select(*GROUP, "span.*", duration_ms(span("start"), span("end")).alias("duration_ms"), *[F.when(has, F.col(n)).alias(n) for n in cause])
