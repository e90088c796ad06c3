"""What a report shows: the chosen timelines with their entries and causes, as plain dictionaries."""

from __future__ import annotations

from datetime import datetime, timezone
from typing import Any

from pyspark.sql import functions as F

from ..operators.filters import filter_timelines
from ..operators.timeline import GROUP
from ..plans.analysis import Analysis

TOOL, VERSION = "tracewright", "0.1.0"


def plain(x: Any) -> Any:
    """Rows, times and maps as JSON can hold them; what is empty is left out."""
    if isinstance(x, datetime):
        return x.replace(tzinfo=timezone.utc).isoformat().replace("+00:00", "Z")
    if hasattr(x, "asDict"):
        x = x.asDict()
    if isinstance(x, dict):
        return {k: v for k, v in ((k, plain(v)) for k, v in x.items()) if v is not None and v != "" and v != [] and v != {}}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return x


def collect(analysis: Analysis, inputs: list[str], trace: str | None = None, only_failed: bool = False, top: int = 100, max_entries: int = 2000) -> dict:
    """The report of at most `top` timelines and `max_entries` entries of each; all counters describe everything."""
    chosen = filter_timelines(analysis.timelines, trace, only_failed, top)
    spans = [r.asDict(True) for r in chosen.collect()]
    keys = analysis.entries.sparkSession.createDataFrame([(s["corr_kind"], s["corr_key"]) for s in spans], "corr_kind string, corr_key string")
    keys = F.broadcast(keys)  # at most `top` rows
    entries: dict[tuple, list] = {}
    for r in analysis.entries.join(keys, GROUP, "left_semi").where(F.col("entry_no") <= max_entries).orderBy(*GROUP, "entry_no").toLocalIterator():
        entries.setdefault((r["corr_kind"], r["corr_key"]), []).append(r.asDict(True))
    causes: dict[tuple, list] = {}
    for r in analysis.causes.join(keys, GROUP, "left_semi").orderBy(*GROUP, "rank").toLocalIterator():
        causes.setdefault((r["corr_kind"], r["corr_key"]), []).append(r.asDict(True))
    spans.sort(key=lambda s: (s["start"] is None, s["start"] or datetime.min, s["first_seq"])) if len(spans) < top else None
    for s in spans:
        key = s["corr_kind"], s["corr_key"]
        s["entries"] = entries.get(key, [])
        found = causes.get(key, [])
        s["root_cause"], s["alternatives"] = (found[0] if found else None), found[1:]
    warnings = [f"{r['source_file']}: {r['warning']}" for r in analysis.warnings.distinct().limit(1000).collect()] if analysis.warnings is not None else []
    return {"generated_at": datetime.now(timezone.utc), "tool": TOOL, "version": VERSION, "inputs": inputs, "summary": analysis.summary.first().asDict(), "timelines": spans, "warnings": sorted(warnings)}
