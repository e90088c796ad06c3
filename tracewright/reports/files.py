"""Reports written by the executors: one JSON document a timeline, with its entries and causes.  The driver sees none of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.filters import filter_timelines
from ..operators.timeline import GROUP
from ..plans.analysis import Analysis


def pruned(value: Column, kind: T.DataType) -> Column:
    """A value without what is empty inside it; null if nothing is left.  Times as text."""
    if isinstance(kind, T.StringType):
        return F.nullif(value, F.lit(""))
    if isinstance(kind, T.TimestampType):
        return F.replace(F.date_format(F.to_utc_timestamp(value, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit(".000000Z"), F.lit("Z"))
    if isinstance(kind, T.ArrayType):
        return F.when(F.size(value) > 0, F.transform(value, lambda x: pruned(x, kind.elementType)))
    if isinstance(kind, T.MapType):
        kept = F.map_filter(F.transform_values(value, lambda _, v: pruned(v, kind.valueType)), lambda _, v: v.isNotNull())
        return F.when(F.size(kept) > 0, kept)
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[pruned(value[f.name], f.dataType).alias(f.name) for f in kind]))
    return value


def _rows(d: DataFrame, place: str, name: str) -> DataFrame:
    """Rows of each timeline as a list, in their order."""
    held = F.collect_list(F.struct(F.col(place).alias("_at"), F.struct(*d.columns).alias("row")))
    # maps have no order, so rows go by their place alone
    placed = F.array_sort(held, lambda a, b: F.when(a["_at"] < b["_at"], -1).when(a["_at"] > b["_at"], 1).otherwise(0))
    return d.groupBy(*GROUP).agg(F.transform(placed, lambda x: x["row"]).alias(name))


def timeline_documents(analysis: Analysis, trace: str | None = None, only_failed: bool = False, top: int | None = None, max_entries: int = 2000) -> DataFrame:
    """corr_kind, corr_key, document: a timeline as reports.model.collect() has it, as JSON text.

    Of a timeline the first `max_entries` entries are shown, as in every report, which also bounds a document; all its counters describe everything.
    """
    spans = filter_timelines(analysis.timelines, trace, only_failed, top)
    entries = _rows(analysis.entries.where(F.col("entry_no") <= max_entries), "entry_no", "entries")
    causes = _rows(analysis.causes, "rank", "causes")
    d = spans.join(entries, GROUP, "left").join(causes, GROUP, "left")
    d = d.withColumns({"root_cause": F.get("causes", F.lit(0)), "alternatives": F.slice("causes", 2, F.greatest(F.size("causes") - 1, F.lit(0)))}).drop("causes")
    fields = [pruned(F.col(f.name), f.dataType).alias(f.name) for f in d.schema]
    return d.select(*GROUP, F.to_json(F.struct(*fields)).alias("document"))


def write_timelines(analysis: Analysis, path: str, **chosen: str | bool | int | None) -> None:
    """Documents as lines of text files at a path of any file system that Spark knows."""
    timeline_documents(analysis, **chosen).select("document").write.text(path)
