"""Rules as column expressions over entries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.levels import at_least
from ..functions.stacks import suppressed_types
from ..operators.scan import Running, running
from ..operators.timeline import GROUP, NOTES, by_entry, first_of_each, note
from .model import Condition, Rule, in_order


def _finds(text: Column, regex: str, case: bool) -> Column:
    return F.coalesce(text.rlike(("(?s)" if case else "(?is)") + regex), F.lit(False))


def matches(c: Condition) -> Column:
    """Whether an entry meets a condition; cheap comparisons stand before regexes."""
    if c.empty():
        return F.lit(False)
    terms: list[Column] = []
    status = F.col("http.status")
    if c.level:
        terms.append(F.col("level") == c.level)
    if c.levelAtLeast:
        terms.append(at_least(F.col("level"), c.levelAtLeast))
    if c.kind:
        terms.append(F.col("kind") == c.kind)
    if c.httpStatus:
        terms.append(F.coalesce(status.isin(*c.httpStatus), F.lit(False)))
    if c.httpStatusClass:
        bounds = {"1xx": (None, 200), "2xx": (200, 300), "3xx": (300, 400), "4xx": (400, 500), "5xx": (500, None)}
        low, high = bounds.get(c.httpStatusClass.lower(), (1, 0))
        inside = (F.lit(True) if low is None else status >= low) & (F.lit(True) if high is None else status < high)
        terms.append(F.coalesce(status.isNotNull() & inside, F.lit(False)))
    if c.minDurationMs is not None:
        took = F.coalesce(F.col("http.duration_ms"), F.try_element_at("attributes", F.lit("durationMs")).try_cast("long"), F.lit(0))
        terms.append(took >= c.minDurationMs)
    for key, regex in c.attributes:
        terms.append(_finds(F.try_element_at("attributes", F.lit(key)), regex, c.caseSensitive))
    if c.loggerRegex:
        terms.append(_finds(F.col("logger"), c.loggerRegex, c.caseSensitive))
    if c.threadRegex:
        terms.append(_finds(F.col("thread"), c.threadRegex, c.caseSensitive))
    if c.exceptionType:
        kind = c.exceptionType
        terms.append(F.coalesce(F.exists("exception", lambda x: _finds(x["type"], kind, c.caseSensitive) | F.coalesce(F.exists(suppressed_types(x), lambda s: _finds(s, kind, c.caseSensitive)), F.lit(False))), F.lit(False)))
    if c.exceptionMessageRegex:
        said = c.exceptionMessageRegex
        terms.append(F.coalesce(F.exists("exception", lambda x: _finds(x["message"], said, c.caseSensitive)), F.lit(False)))
    if c.messageRegex:
        terms.append(_finds(F.col("search_text"), c.messageRegex, c.caseSensitive))
    if c.anyMessageRegex:
        terms.append(reduce(lambda a, b: a | b, [_finds(F.col("search_text"), r, c.caseSensitive) for r in c.anyMessageRegex]))
    return reduce(lambda a, b: a & b, terms)


def _looks_back(condition: Column) -> tuple[Column, Column]:
    """Numbers of entries that meet a condition, and their times; the last ones before an entry decide."""
    return F.when(condition, F.col("entry_no")), F.when(condition, F.unix_micros("ts"))


def preceded(condition: Column, within_seconds: int) -> Column:
    """An earlier entry of the timeline meets a condition, as a window over whole timelines."""
    before = Window.partitionBy(*GROUP).orderBy("entry_no").rowsBetween(Window.unboundedPreceding, -1)
    return _preceded(*[F.last(c, ignorenulls=True).over(before) for c in _looks_back(condition)], within_seconds)


def _preceded(hit: Column, last_at: Column, within_seconds: int) -> Column:
    """An earlier entry of the timeline meets a condition, within so many seconds (0: any time).

    Going back ends at the first dated entry beyond the window; an undated side is not checked.
    """
    if not within_seconds:
        return hit.isNotNull()
    limit = F.unix_micros("ts") - within_seconds * 1_000_000
    # entries go by time, so the last hit decides: it is dated and inside, or nothing stands between that ends the search
    return F.coalesce(F.when(F.col("ts").isNull(), hit.isNotNull()).otherwise(hit.isNotNull() & (last_at >= limit)), F.lit(False))


def apply_rules(entries: DataFrame, rules: list[Rule], block_entries: int = 0) -> DataFrame:
    """entries with hits (indexes into the ordered rules, first to last) and the rules' annotations added."""
    ordered = in_order(rules)
    needed = {f"_{name}{i}": Running("before", c) for i, r in enumerate(ordered) if r.precededBy for name, c in zip(("hit", "at"), _looks_back(matches(r.precededBy.when)), strict=True)}
    d = running(entries, GROUP, [F.col("entry_no")], needed, by_entry(block_entries)) if needed else entries
    back = lambda i, r: _preceded(F.col(f"_hit{i}"), F.col(f"_at{i}"), r.precededBy.withinSeconds) if r.precededBy else F.lit(True)
    hits = [F.when(matches(r.when) & back(i, r), F.lit(i)) for i, r in enumerate(ordered)]
    found = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<int>")
    d = d.withColumn("hits", found.cast("array<int>"))
    if stops := [i for i, r in enumerate(ordered) if r.stopOnMatch]:
        at = F.filter(F.sequence(F.lit(1), F.size("hits")), lambda k: F.get(F.col("hits"), k - 1).isin(stops))
        d = d.withColumn("hits", F.when(F.exists("hits", lambda h: h.isin(stops)), F.slice("hits", 1, F.get(at, 0))).otherwise(F.col("hits")))
    table = F.array(*[F.array(*[note(kind, F.lit(label if label is not None else r.description), r.name) for kind, label in r.annotate]).cast(NOTES) for r in ordered]) if ordered else F.array(F.array().cast(NOTES))
    more = F.flatten(F.transform("hits", lambda h: F.get(table, h)))
    return d.withColumn("annotations", first_of_each(F.concat("annotations", more))).drop(*needed)


def rule_hits(ruled: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row a hit: timeline, entry_no, rule_no (order of the rule) and rule."""
    names = F.array(*[F.lit(r.name) for r in in_order(rules)]).cast("array<string>")
    return ruled.select(*GROUP, "entry_no", "entry_id", F.explode("hits").alias("rule_no")).withColumn("rule", F.get(names, F.col("rule_no")))
