"""Writers of a collected report: JSON, text, HTML, Mermaid, and a prompt for a language model."""

from __future__ import annotations

import html
import json
import textwrap
from datetime import datetime
from typing import Any, Protocol, TextIO

from .model import plain


def _time(t: datetime | None) -> str:
    return t.strftime("%H:%M:%S.%f")[:-3] if t else "--:--:--.---"


def _first_line(text: str | None, most: int = 160) -> str:
    line = (text or "").split("\n", 1)[0]
    return line if len(line) <= most else line[: most - 3] + "..."


def _percent(x: float) -> str:
    return f"{int(x * 100 + 0.5)}%"


def _short_logger(name: str | None, most: int = 26) -> str:
    if not name or len(name) <= most or "." not in name:
        return name or ""
    *packages, last = name.split(".")
    return ".".join([p[:1] for p in packages] + [last])


def _stack(entry: dict, most: int) -> list[str]:
    out = []
    for i, link in enumerate(entry.get("exception") or []):
        out.append(("Caused by: " if i else "") + ": ".join(x for x in (link["type"], link["message"]) if x))
        frames = link["frames"] or []
        out += [f"    {f['raw']}" for f in frames[:most]]
        left = len(frames) - most + (link["omitted"] or 0) if len(frames) > most else link["omitted"] or 0
        if left > 0:
            out.append(f"    ... {left} more")
    return out


def to_json(report: dict, pretty: bool = True) -> str:
    out = plain(report)
    out["summary"] = report["summary"]
    return json.dumps(out, ensure_ascii=False, indent=2 if pretty else None)


def to_text(report: dict, only_failed: bool = False, max_stack_frames: int = 8, max_entries: int = 200, stacks: bool = True) -> str:
    s = report["summary"]
    out = ["INCIDENT REPORT", "inputs: " + ", ".join(report["inputs"])]
    out.append(f"events {s['total_events']}, errors {s['error_events']}, warnings {s['warning_events']}, exceptions {s['exception_events']}, timelines {s['timelines']}, failed {s['failed_timelines']}")
    out += [f"warning: {w}" for w in report["warnings"]]
    for n, t in enumerate([t for t in report["timelines"] if t["is_failed"] or not only_failed], 1):
        out += ["", "=" * 78, f"#{n} {t['corr_kind']} {t['corr_key']}  {'FAILED' if t['is_failed'] else 'ok'}"]
        out.append(f"{t['start'] or '-'} .. {t['end'] or '-'}  {t['duration_ms'] or 0} ms, events {t['event_count']}, errors {t['error_count']}" + (f", services {', '.join(t['services'])}" if t["services"] else ""))
        if cause := t["root_cause"]:
            out.append(f"PROBABLE CAUSE ({_percent(cause['confidence'])}): {cause['title']}")
            out += textwrap.wrap(cause["description"] or "", 70, initial_indent="  ", subsequent_indent="  ")
            out += textwrap.wrap("Advice: " + cause["recommendation"], 70, initial_indent="  ", subsequent_indent="  ") if cause["recommendation"] else []
            out += [f"  - {e['entry_id']} {e['summary']}" for e in cause["evidence"]]
            out += [f"  or ({_percent(a['confidence'])}): {a['title']}" for a in t["alternatives"]]
        for e in t["entries"][:max_entries]:
            times = f" x{e['repeat_count']}" if e["repeat_count"] > 1 else ""
            out.append(f"{e['entry_id']:>5} {_time(e['ts'])} {e['level']:<7} {_short_logger(e['logger']):<26} {_first_line(e['summary'])}{times}")
            marks: dict[str, str] = {}
            for a in e["annotations"]:
                if a["type"] not in marks or a["rule"] != "builtin":
                    marks[a["type"]] = a["label"]
            if marks:
                out.append(" " * 6 + "; ".join(f"{k}: {v}" for k, v in marks.items()))
            if stacks:
                out += [" " * 6 + x for x in _stack(e, max_stack_frames)]
        if len(t["entries"]) > max_entries:
            out.append(f"      ... {len(t['entries']) - max_entries} more entries")
    return "\n".join(out) + "\n"


def to_mermaid(report: dict, only_failed: bool = True, max_timelines: int = 10, max_entries: int = 40) -> str:
    clean = lambda s: (s[:57] + "..." if len(s) > 60 else s).replace(":", "-").replace(",", ";").replace("#", " ").replace("\n", " ")
    out = ["gantt", "    title Incidents", "    dateFormat x", "    axisFormat %H:%M:%S"]
    for t in [t for t in report["timelines"] if t["is_failed"] or not only_failed][:max_timelines]:
        out.append(f"    section {clean(t['corr_kind'] + ' ' + t['corr_key'])}")
        dated = [e for e in t["entries"][:max_entries] if e["ts"]]
        for e, after in zip(dated, [*dated[1:], None], strict=True):
            at = int(e["ts"].timestamp() * 1000)
            last = max(1, int(after["ts"].timestamp() * 1000) - at) if after else 1
            tag = "crit" if e["is_error"] else "active" if e["level"] == "WARN" else "done"
            out.append(f"    {clean(_first_line(e['summary']) or e['entry_id'])} :{tag}, {at}, {last}ms")
    return "\n".join(out) + "\n"


STYLE = "body{font:14px sans-serif;margin:2em}.failed{border-left:4px solid #c33}.ok{border-left:4px solid #3a3}section{padding:0 1em;margin:1em 0}table{border-collapse:collapse}td{padding:2px 8px;vertical-align:top}.ERROR,.FATAL{color:#c33}.WARN{color:#b70}pre{margin:0}.scale{position:relative;height:10px;background:#eee}.scale i{position:absolute;width:3px;height:10px;background:#36c}.scale i.bad{background:#c33}"
SCRIPT = "document.getElementById('q').oninput=e=>{for(const r of document.querySelectorAll('tr'))r.style.display=r.textContent.toLowerCase().includes(e.target.value.toLowerCase())?'':'none'};document.getElementById('f').onchange=e=>{for(const s of document.querySelectorAll('section.ok'))s.style.display=e.target.checked?'none':''}"


def to_html(report: dict, max_stack_frames: int = 8) -> str:
    esc = lambda x: html.escape(str(x if x is not None else ""), quote=True)
    s = report["summary"]
    out = [f"<!doctype html><meta charset=utf-8><title>Incidents</title><style>{STYLE}</style><h1>Incidents</h1><p>{esc(', '.join(report['inputs']))}</p>"]
    out.append("<p>" + ", ".join(f"{k.replace('_', ' ')} <b>{v}</b>" for k, v in s.items()) + "</p>")
    out.append("<p><input id=q placeholder=search> <label><input id=f type=checkbox> failed only</label></p>")
    out += [f"<p class=WARN>{esc(w)}</p>" for w in report["warnings"]]
    for t in report["timelines"]:
        out.append(f"<section class={'failed' if t['is_failed'] else 'ok'}><h2>{esc(t['corr_kind'])} {esc(t['corr_key'])}</h2><p>{esc(t['start'])} &ndash; {esc(t['end'])}, {esc(t['duration_ms'] or 0)} ms, errors {t['error_count']}</p>")
        if c := t["root_cause"]:
            out.append(f"<p><b>{esc(c['title'])}</b> ({_percent(c['confidence'])})<br>{esc(c['description'])}<br><i>{esc(c['recommendation'])}</i><br>" + ", ".join(f"<a href='#{esc(t['corr_key'])}-{e['entry_id']}'>{e['entry_id']}</a>" for e in c["evidence"]) + "</p>")
            out += [f"<p>or: {esc(a['title'])} ({_percent(a['confidence'])})</p>" for a in t["alternatives"]]
        if t["duration_ms"]:
            out.append("<div class=scale>" + "".join(f"<i class='{'bad' if e['is_error'] else ''}' style='left:{min(100, 100 * (e['since_start_ms'] or 0) / t['duration_ms']):.2f}%'></i>" for e in t["entries"] if e["ts"]) + "</div>")
        out.append("<table>")
        for e in t["entries"]:
            notes = "; ".join(f"{a['type']}: {a['label']}" for a in e["annotations"])
            stack = "\n".join(_stack(e, max_stack_frames))
            out.append(f"<tr id='{esc(t['corr_key'])}-{e['entry_id']}'><td>{e['entry_id']}<td>{_time(e['ts'])}<td class={esc(e['level'])}>{esc(e['level'])}<td>{esc(_short_logger(e['logger']))}<td>{esc(_first_line(e['summary'], 300))}<br><small>{esc(notes)}</small>" + (f"<pre>{esc(stack)}</pre>" if stack else ""))
        out.append("</table></section>")
    return "\n".join([*out, f"<script>{SCRIPT}</script>"])


SYSTEM = "You look for the cause of a failure in a Java service. Use only the log entries given; name entries as evidence; say so when they do not suffice."


def to_prompt(report: dict, trace: str | None = None, max_entries: int = 60, max_frames: int = 6) -> str:
    """A prompt about one timeline: the one named, else the failed one of most errors.  Nothing is sent anywhere."""
    found = [t for t in report["timelines"] if (trace in t["corr_key"] if trace else t["is_failed"])]
    if not found:
        return ""
    t = max(found, key=lambda t: t["error_count"])
    out = [SYSTEM, "", f"Timeline {t['corr_kind']} {t['corr_key']}, {t['start']} to {t['end']}, errors {t['error_count']}."]
    if c := t["root_cause"]:
        out.append(f"Rules suggest ({_percent(c['confidence'])}): {c['title']}")
    for e in t["entries"][:max_entries]:
        out.append(f"{e['entry_id']} {_time(e['ts'])} {e['level']} {' '.join((e['summary'] or '').split())[:500]}" + (f" (x{e['repeat_count']})" if e["repeat_count"] > 1 else ""))
        out += ["    " + x for x in _stack(e, max_frames)]
    if len(t["entries"]) > max_entries:
        out.append(f"... {len(t['entries']) - max_entries} more entries")
    out.append("What is the root cause, how sure are you, which entries show it, and what should be done?")
    return "\n".join(out) + "\n"



class ReportWriter(Protocol):
    """A report (reports.model.collect) as text.  Whoever has another format puts it into WRITERS under a name of its own."""

    def __call__(self, report: dict, **options: Any) -> str: ...


WRITERS: dict[str, ReportWriter] = {"json": to_json, "text": to_text, "html": to_html, "mermaid": to_mermaid, "prompt": to_prompt}


def write(report: dict, out: TextIO, form: str = "text", **options: Any) -> None:
    """The report in a named format into anything that takes text."""
    out.write(WRITERS[form](report, **options))
