"""Correlation, timelines, rules, causes, reports, settings and streaming."""

import io
import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tracewright import config as settings
from tracewright.cli import run as cli
from tracewright.config import Correlation, Timeline
from tracewright.operators.correlate import correlate
from tracewright.operators.filters import filter_events, parse_time
from tracewright.operators.rootcause import incidents, root_causes
from tracewright.operators.timeline import build_entries, merge_repeats, timelines
from tracewright.plans.analysis import analyze_events, analyze_text
from tracewright.reports.files import timeline_documents, write_timelines
from tracewright.reports.model import collect, plain
from tracewright.reports.writers import WRITERS, write
from tracewright.rules.compile import apply_rules, preceded, rule_hits
from tracewright.rules.model import builtin_rules, in_order, parse_rules
from tracewright.schema import EVENT
from tracewright.streaming.sessions import inherited_traces, thread_sessions

T0 = datetime(2026, 8, 9, 10)
FIELDS = [c.split()[0] for c in "seq ts level logger thread message trace_id span_id session_id request_id user_id service exception http kind attributes source_file source_line raw".split()]


def events(spark, rows):
    """Rows of (seconds or None, fields)."""
    made = []
    for i, (s, fields) in enumerate(rows):
        e = dict.fromkeys(FIELDS) | {"seq": i, "ts": None if s is None else T0 + timedelta(seconds=s), "level": "INFO", "message": "m", "kind": "LOG", "attributes": {}, "source_file": "f"} | fields
        made.append(tuple(e[f] for f in FIELDS))
    return spark.createDataFrame(made, EVENT)


def groups(df):
    return [(r["corr_kind"], r["corr_key"]) for r in df.orderBy("seq").collect()]


def test_trace_context_session_thread_file(spark):
    d = events(spark, [
        (0, {"trace_id": "t", "thread": "a"}), (5, {"thread": "a"}), (14, {"thread": "a", "session_id": "s"}), (60, {"thread": "a", "session_id": "s"}),
        (70, {"thread": "b"}), (100, {"thread": "b"}), (131, {"thread": "b"}), (140, {}), (150, {"request_id": "r"}),
    ])
    assert groups(correlate(d)) == [("TRACE", "t")] * 3 + [("SESSION", "s"), ("THREAD", "b"), ("THREAD", "b"), ("THREAD", "b#2"), ("FILE", "f"), ("REQUEST", "r")]
    assert len(groups(correlate(d, Correlation(fallback_to_file=False)))) == 8
    assert ("SESSION", "s") in groups(correlate(d, Correlation(inherit_trace_from_thread=False)))[:3]
    own = correlate(events(spark, [(0, {"attributes": {"orderId": "7"}})]), Correlation(additional_keys=("orderId",)))
    assert groups(own) == [("REQUEST", "7")]


def test_min_events_keeps_errors(spark):
    d = events(spark, [(0, {"trace_id": "a"}), (1, {"trace_id": "b"}), (2, {"trace_id": "b"}), (3, {"trace_id": "c", "level": "ERROR"})])
    assert {k for _, k in groups(correlate(d, Correlation(min_events_per_timeline=2)))} == {"b", "c"}


@pytest.mark.parametrize("seed", [1, 2])
def test_context_and_repeats_against_a_plain_scan(spark, seed):
    rnd = random.Random(seed)
    window, dedup = rnd.choice([3, 10]), rnd.choice([4, 300])
    rows = [(rnd.choice([None, rnd.randint(0, 200)]) if rnd.random() < 0.1 else rnd.randint(0, 200), {"thread": rnd.choice("xy"), "trace_id": rnd.choice([None, None, "p", "q"]), "message": rnd.choice(["m 1", "m 2", "n"])}) for _ in range(300)]
    got = correlate(events(spark, rows).repartition(4), Correlation(inherit_window_seconds=window))
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    active, last, want = {}, {}, {}
    for i in order:
        s, f = rows[i]
        t = f["thread"]
        if s is not None and last.get(t) is not None and s - last[t] > window:
            active[t] = None
        last[t] = s
        active[t] = f["trace_id"] or active.get(t)
        want[i] = active[t]
    found = {r["seq"]: r["corr_key"] if r["corr_kind"] == "TRACE" else None for r in got.collect()}
    assert found == want

    merged = {(r["corr_kind"], r["corr_key"], r["seq"]): r["repeat_count"] for r in merge_repeats(got, Timeline(dedup_window_seconds=dedup)).collect()}
    by, plain = {}, {}
    for r in sorted(got.collect(), key=lambda r: order.index(r["seq"])):
        by.setdefault((r["corr_kind"], r["corr_key"]), []).append(r)
    for key, rs in by.items():
        head = before = None
        for r in rs:
            same = before is not None and before["message"][0] == r["message"][0] and (before["ts"] is None or r["ts"] is None or abs((r["ts"] - before["ts"]).total_seconds()) <= dedup)
            head = head if same else r["seq"]
            plain[(*key, head)] = plain.get((*key, head), 0) + 1
            before = r
    assert merged == plain


def test_offsets_links_and_notes(spark):
    http = ("INBOUND", "GET", "/x", None, None, None, None, None, None)
    d = events(spark, [
        (0, {"trace_id": "t", "kind": "HTTP_REQUEST", "http": http}), (1, {"trace_id": "t", "kind": "HTTP_REQUEST", "http": http, "message": "other"}),
        (2, {"trace_id": "t", "kind": "HTTP_RESPONSE", "http": ("OUTBOUND", None, None, "h", 503, None, 2000, None, None)}), (10, {"trace_id": "t", "level": "WARN", "message": "x 1"}), (11, {"trace_id": "t", "level": "WARN", "message": "x 2"}), (None, {"trace_id": "t", "message": "late"}),
    ])
    e = build_entries(correlate(d)).orderBy("entry_no").collect()
    assert [r["related_ids"] for r in e] == [["e3"], ["e3"], ["e1", "e2"], [], []]
    assert [r["since_previous_ms"] for r in e] == [None, 1000, 1000, 8000, None] and e[4]["since_start_ms"] is None
    assert [(a["type"], a["label"]) for a in e[2]["annotations"]] == [("EXTERNAL_CALL", "-> 503 (2000 ms)"), ("HTTP_SERVER_ERROR", "HTTP 503"), ("SLOW", "took 2000 ms")]
    assert [(a["type"], a["label"]) for a in e[3]["annotations"]] == [("WARNING", "warning"), ("SLOW", "pause of 8.0 s before"), ("RETRY", "repeats: 2")]
    t = timelines(build_entries(correlate(d))).first()
    assert (t["event_count"], t["entry_count"], t["error_count"], t["warning_count"], t["duration_ms"]) == (6, 5, 1, 1, 11000)


RULES = """
rules:
- {name: low, priority: 1, when: {level: ERROR}, annotate: [{type: INFO}], description: said}
- {name: high, priority: 9, when: {levelAtLeast: WARN, messageRegex: BOOM}, stopOnMatch: true, cause: {title: boom}}
- {name: disabled, enabled: false, when: {level: ERROR}}
- {name: before, priority: 5, when: {level: ERROR}, precededBy: {withinSeconds: 10, when: {messageRegex: retry}}}
"""


def test_rules(spark):
    d = events(spark, [(0, {"trace_id": "t", "message": "Retry"}), (10, {"trace_id": "t", "level": "ERROR", "message": "a"}), (21, {"trace_id": "t", "level": "ERROR", "message": "b"}), (22, {"trace_id": "t", "level": "ERROR", "message": "it went boom"})])
    rules = parse_rules(RULES)
    assert [r.name for r in in_order(rules)] == ["high", "before", "low"]
    ruled = apply_rules(build_entries(correlate(d)), rules)
    assert sorted((r["entry_no"], r["rule"]) for r in rule_hits(ruled, rules).collect()) == [(2, "before"), (2, "low"), (3, "low"), (4, "high")]
    assert ("INFO", "said") in [(a["type"], a["label"]) for a in ruled.where("entry_no = 3").first()["annotations"]]
    assert apply_rules(build_entries(correlate(d)), []).select("hits").first()["hits"] == []


def test_preceded_against_a_plain_scan(spark):
    rnd = random.Random(3)
    rows = [(None if rnd.random() < 0.1 else rnd.randint(0, 60), {"trace_id": rnd.choice("ab"), "message": rnd.choice(["hit", f"{rnd.random()}x{i}q"]) + "z" * i}) for i in range(120)]
    e = build_entries(correlate(events(spark, rows)), Timeline(dedup=False))
    got = {(r["corr_key"], r["entry_no"]): r["p"] for r in e.withColumn("p", preceded(F.col("message").startswith("hit"), 7)).collect()}
    every = {}
    for r in e.orderBy("entry_no").collect():
        every.setdefault(r["corr_key"], []).append(r)
    for key, rs in every.items():
        for i, r in enumerate(rs):
            want = False
            for c in reversed(rs[:i]):
                if r["ts"] and c["ts"] and (r["ts"] - c["ts"]).total_seconds() > 7:
                    break
                if c["message"].startswith("hit"):
                    want = True
                    break
            assert got[key, r["entry_no"]] == want


def test_builtin_rules_and_strictness():
    assert len(builtin_rules()) == 55
    for bad in ("rules: [{name: a, when: {}}]", "rules: [{name: a, when: {level: ERROR}}, {name: a, when: {level: WARN}}]", "rules: [{name: a, when: {levle: ERROR}}]", "rules: [{name: a, when: {level: LOUD}}]", "rules: [{when: {level: ERROR}}]", "rules: [{name: a, when: {level: ERROR}, cause: {confidence: 2}}]"):
        with pytest.raises(ValueError):
            parse_rules(bad)
    c = settings.build(settings.Config, {"timeline": {"slowMs": 5}, "correlation": {"priority": ["trace"]}})
    assert c.timeline.slow_ms == 5 and c.correlation.priority == ("TRACE",)
    with pytest.raises(ValueError):
        settings.build(settings.Config, {"timeline": {"slow": 5}})


INCIDENT = """2026-08-09T10:00:00Z  INFO 1 --- [orders] [exec-1] [aaaaaaaa11111111,b] c.e.Api : Received
2026-08-09T10:00:01Z  WARN 1 --- [orders] [exec-1] [aaaaaaaa11111111,b] c.e.Client : Read timed out, Retrying attempt 1
2026-08-09T10:00:02Z ERROR 1 --- [orders] [exec-1] [aaaaaaaa11111111,b] c.e.Orders : Failed <b>
java.lang.IllegalStateException: outer
\tat com.acme.A.b(A.java:10)
Caused by: java.lang.NullPointerException: boom
\tat java.util.Objects.requireNonNull(Objects.java:1)
\tat com.acme.C.d(C.java:20)
2026-08-09T10:00:03Z ERROR 1 --- [orders] [exec-1] [aaaaaaaa11111111,b] c.e.Orders : And again
2026-08-09T10:00:03Z  INFO 1 --- [orders] [exec-2] [cccccccc22222222,b] c.e.Api : fine
"""


@pytest.fixture(scope="module")
def report(spark):
    return collect(analyze_text(spark, INCIDENT), ["snippet"])


def test_causes(report):
    t = next(t for t in report["timelines"] if t["is_failed"])
    every = [t["root_cause"], *t["alternatives"]]
    assert len(every) == 4 and every == sorted(every, key=lambda c: -c["confidence"])
    # 0.85 + 0.07 + 0.025 of the null reference on the first error
    assert t["root_cause"]["rule"] == "null-pointer" and t["root_cause"]["confidence"] == pytest.approx(0.945)
    assert [e["entry_id"] for e in t["root_cause"]["evidence"]] == ["e3", "e2"]
    assert report["summary"] == {"total_events": 5, "error_events": 2, "warning_events": 1, "exception_events": 1, "timelines": 2, "failed_timelines": 1}
    healthy = next(t for t in report["timelines"] if not t["is_failed"])
    assert healthy["root_cause"] is None


def test_writers(report):
    out = {name: w(report) for name, w in WRITERS.items()}
    assert json.loads(out["json"])["timelines"][0]["corr_key"] == "aaaaaaaa11111111"
    assert "PROBABLE CAUSE (95%): Null reference" in out["text"] and "... " not in out["text"].split("e1")[0]
    assert "Failed &lt;b&gt;" in out["html"] and "<b>\n" not in out["html"]
    assert out["mermaid"].startswith("gantt") and ":crit" in out["mermaid"] and "cccccccc" not in out["mermaid"]
    assert "aaaaaaaa11111111" in out["prompt"]


def test_documents_by_executors(spark, tmp_path):
    found = analyze_text(spark, INCIDENT)
    write_timelines(found, str(tmp_path / "out"))
    got = {d["corr_key"]: d for d in map(json.loads, (r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()))}
    want = {t["corr_key"]: t for t in json.loads(json.dumps(plain(collect(found, ["snippet"])["timelines"])))}
    assert got == want and len(got) == 2
    assert timeline_documents(found, only_failed=True, max_entries=1).count() == 1


def test_incidents_in_one_partitioning(spark):
    found = analyze_text(spark, INCIDENT)
    rules = builtin_rules()
    for asked in (settings.Analysis(), settings.Analysis(block_entries=2), settings.Analysis(min_confidence=0.99)):
        got = {r["corr_key"]: r.asDict(True) for r in incidents(found.entries, rules, asked).collect()}
        spans = {r["corr_key"]: r.asDict() for r in found.timelines.where("is_failed").collect()}
        causes = {r["corr_key"]: r.asDict(True) for r in root_causes(found.entries, rules, asked).where("rank = 1").collect()}
        assert set(got) == set(spans) and got
        for key, r in got.items():
            assert {n: r[n] for n in ("start", "end", "event_count", "entry_count", "error_count", "warning_count", "duration_ms")} == {n: spans[key][n] for n in ("start", "end", "event_count", "entry_count", "error_count", "warning_count", "duration_ms")}
            want = causes.get(key, dict.fromkeys(("title", "confidence", "entry_no", "evidence")))
            assert {n: r[n] for n in ("title", "confidence", "entry_no", "evidence")} == {n: want[n] for n in ("title", "confidence", "entry_no", "evidence")}
    assert not causes  # none is as sure as that, and the timelines stay
    plan = incidents(found.entries, rules)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("InMemoryRelation")[0]  # kept entries lie by timeline already


def test_pasted_text_and_other_writers(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr("sys.stdin", io.StringIO(INCIDENT))
    assert cli(["analyze", "-p", "-f", "json"]) == 0
    report = json.loads(capsys.readouterr().out)
    assert len(report["timelines"]) == 2
    assert cli(["analyze", "-p", "--stdin"]) == 1
    monkeypatch.setitem(WRITERS, "count", lambda report, **options: f"{len(report['timelines'])} {options}")
    out = io.StringIO()
    write(report, out, "count", wide=True)
    assert out.getvalue() == "2 {'wide': True}"
    for name in "ab":
        (tmp_path / f"{name}.yaml").write_text(f"rules:\n- {{name: rule-{name}, when: {{level: ERROR}}}}\n")
    assert cli(["rules", "--no-builtin-rules", "--rules", f"{tmp_path}/a.yaml,{tmp_path}/b.yaml"]) == 0
    said = capsys.readouterr().out
    assert "rule-a" in said and "rule-b" in said


def test_command_line(spark, tmp_path, capsys):
    assert cli(["analyze"]) == 1 and cli(["analyze", "-t", " "]) == 1 and cli(["analyze", "-i", str(tmp_path / "no.log")]) == 1
    assert cli(["rules"]) == 0 and "null-pointer" in capsys.readouterr().out
    assert cli(["patterns", "10:00:00 [main] INFO a.B - x"]) == 0 and cli(["patterns", "x"]) == 1


def test_filters(spark):
    d = events(spark, [(0, {}), (10, {"level": "ERROR"}), (None, {"level": "UNKNOWN"}), (20, {"level": "WARN"})])
    assert [r["seq"] for r in filter_events(d, "2026-08-09 10:00:10", "2026-08-09 10:00:20").orderBy("seq").collect()] == [1, 2, 3]
    assert [r["seq"] for r in filter_events(d, min_level="WARN").orderBy("seq").collect()] == [1, 3]


def test_streaming(spark, tmp_path):
    d = events(spark, [(0, {"thread": "a", "trace_id": "t"}), (5, {"thread": "a"}), (35, {"thread": "a", "level": "ERROR"}), (66, {"thread": "a"}), (1000, {"thread": "z"})])
    # sessions have the same meaning over a finished table
    assert sorted((r["events"], r["errors"]) for r in thread_sessions(d).where("thread = 'a'").collect()) == [(1, 0), (3, 1)]
    d.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    assert thread_sessions(live).isStreaming and inherited_traces(live).columns == ["seq", "thread", "trace_id"]


def test_rules_exported_and_validated(tmp_path, capsys):
    made = tmp_path / "new" / "rules.yaml"
    assert cli(["rules", "--export", str(made)]) == 0
    assert parse_rules(made.read_text(encoding="utf-8")) == builtin_rules()
    assert cli(["rules", "--validate", str(made)]) == 0 and "55 rules" in capsys.readouterr().out
    made.write_text("rules:\n- {name: x, when: {}}\n", encoding="utf-8")
    assert cli(["rules", "--validate", str(made)]) == 1
    assert cli(["rules", "--validate", str(tmp_path / "none.yaml")]) == 1


def test_one_note_for_a_null_reference(report):
    notes = [[(a["type"], a["label"]) for a in e["annotations"]] for t in report["timelines"] for e in t["entries"]]
    of_null = [n for n in notes if ("EXCEPTION", "root: NullPointerException") in n or ("EXCEPTION", "NullPointerException") in n]
    assert of_null and all(len(n) == len(set(n)) for n in notes)
    labels = {r.name: [label for _, label in r.annotate] for r in builtin_rules()}
    assert labels["null-pointer"] == ["NullPointerException"] and labels["socket-timeout"][1] == labels["connect-timeout"][1]


def test_times_of_filters(tmp_path):
    utc = lambda t, **more: parse_time(t, **more).astimezone(timezone.utc).replace(tzinfo=None)
    assert parse_time(None) is None and parse_time(" ") is None
    assert utc("2026-08-09T10:00:00Z") == utc("2026-08-09T13:00:00.000000000+03:00") == datetime(2026, 8, 9, 10)
    assert utc("2026-08-09 13:00", zone="Europe/Moscow") == datetime(2026, 8, 9, 10)
    assert parse_time("2026-08-09T10:00:00").replace(tzinfo=None) == datetime(2026, 8, 9, 10)
    for bad in ("soon", "2026-08-09", "2026-02-30T10:00:00", "10:00:00", "2026-08-09 10:00:00Z"):
        with pytest.raises(ValueError):
            parse_time(bad)
    assert cli(["analyze", "-t", "10:00:00 INFO a.B - x", "--since", "soon"]) == 1


def test_a_null_reference_gets_one_note(spark):
    made = events(spark, [(0, {"trace_id": "t", "level": "ERROR", "kind": "EXCEPTION", "exception": [("java.lang.NullPointerException", "boom", [], 0, [])]})])
    entries = apply_rules(build_entries(correlate(made)), builtin_rules()).collect()
    assert [(a["type"], a["label"]) for a in entries[0]["annotations"] if a["type"] == "EXCEPTION"] == [("EXCEPTION", "NullPointerException")]


def test_another_analyzer(spark):
    mine = lambda entries, rules, given: entries.where("is_error").select("corr_key", F.lit("mine").alias("title"))
    found = analyze_events(events(spark, [(0, {"trace_id": "t", "level": "ERROR"}), (1, {"trace_id": "u"})]), rules=[], analyzer=mine)
    assert [tuple(r) for r in found.causes.collect()] == [("t", "mine")]
