"""Lines to events: formats, time stamps, stack traces, JSON, HTTP dumps, boundaries."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tracewright.config import CustomPattern, Parse
from tracewright.functions.stacks import exception_chain, is_header
from tracewright.functions.timestamps import parse_timestamp
from tracewright.operators.records import parse_lines, record_starts
from tracewright.operators.text_patterns import text_fields
from tracewright.rules.compile import matches
from tracewright.rules.model import Condition
from tracewright.schema import LINK
from tracewright.sources.files import expand, from_files, from_text

PARSE = Parse(default_date="2026-08-09")
LOG = """2026-08-09T10:00:00.000+03:00  INFO 1 --- [orders] [exec-1] [8f3c2a1b4d5e6f70,aa11bb22cc33dd44] c.e.Api : Received order userId=77
2026-08-09T10:00:01.000+03:00 ERROR 1 --- [orders] [exec-1] [8f3c2a1b4d5e6f70,aa11bb22cc33dd44] c.e.Orders : Failed
second line
java.lang.IllegalStateException: outer
\tat com.acme.A.b(A.java:10) ~[app.jar:1]
\tSuppressed: java.lang.RuntimeException: hidden
{"@timestamp":"2026-08-09T07:00:02Z","level":"error","message":"json sid=abc","traceId":"t1","mdc":{"sessionId":"s1","tenant":"x"},"stack_trace":"java.net.SocketTimeoutException: Read timed out\\n\\tat a.B.c(B.java:1)","status":503,"method":"GET","uri":"/x","a":{"b":{"c":1}}}
GET /api/x HTTP/1.1
Host: example.org
X-Request-Id: r-1

{"a": 1}
HTTP/1.1 502 Bad Gateway

sessionid=zzz took 12 ms
10:00:03.5 [t1] WARN  a.B - call POST https://pay.test/x status=404 elapsed 1,5 s
"""


@pytest.fixture(scope="module")
def events(spark):
    return [r.asDict(True) for r in parse_lines(from_text(spark, "﻿" + LOG), PARSE).orderBy("seq").collect()]


def test_formatted_line(events):
    e = events[0]
    assert (e["level"], e["thread"], e["logger"], e["service"]) == ("INFO", "exec-1", "c.e.Api", "orders")
    assert (e["trace_id"], e["span_id"], e["user_id"]) == ("8f3c2a1b4d5e6f70", "aa11bb22cc33dd44", "77")
    assert e["ts"] == datetime(2026, 8, 9, 7) and e["attributes"]["pid"] == "1" and e["source_line"] == 1


def test_tail_and_stack(events):
    e = events[1]
    assert e["message"] == "Failed\nsecond line" and e["kind"] == "EXCEPTION"
    assert [x["type"] for x in e["exception"]] == ["java.lang.IllegalStateException"]
    assert [x["type"] for x in e["exception"][0]["suppressed"]] == ["java.lang.RuntimeException"] and e["exception"][0]["frames"][0]["line"] == 10


def test_json_record(events):
    e = events[2]
    assert (e["level"], e["trace_id"], e["kind"]) == ("ERROR", "t1", "EXCEPTION")
    assert e["session_id"] == "abc"  # the text's pair comes last
    assert e["exception"][0]["message"] == "Read timed out" and e["http"]["status"] == 503
    assert e["attributes"]["a.b.c"] == "1" and e["attributes"]["tenant"] == "x" and e["attributes"]["mdc.tenant"] == "x"


def test_http_dump(events):
    ask, answer = events[3], events[4]
    assert ask["kind"] == "HTTP_REQUEST" and ask["request_id"] == "r-1" and ask["http"]["host"] == "example.org" and ask["http"]["body"] == '{"a": 1}'
    assert answer["kind"] == "HTTP_RESPONSE" and answer["level"] == "ERROR" and answer["message"] == "-> 502 Bad Gateway"
    assert answer["session_id"] == "zzz" and answer["attributes"]["durationMs"] == "12"
    assert answer["ts"] == datetime(2026, 8, 9, 7, 0, 2) and answer["attributes"]["timestampInherited"] == "true"


def test_time_only_and_mined_call(events):
    e = events[5]
    assert e["ts"] == datetime(2026, 8, 9, 10, 0, 3, 500000) and e["level"] == "WARN"
    assert e["http"]["direction"] == "OUTBOUND" and e["http"]["host"] == "pay.test" and e["http"]["status"] == 404 and e["http"]["duration_ms"] == 1500


def test_orphans_and_unparsed(spark):
    got = [r.asDict(True) for r in parse_lines(from_text(spark, "just text\n\njava.lang.IllegalArgumentException: bad\n\tat a.B.c(B.java:1)\n"), PARSE).orderBy("seq").collect()]
    assert [(e["kind"], e["level"]) for e in got] == [("UNPARSED", "UNKNOWN"), ("LOG", "ERROR")] or [e["kind"] for e in got] == ["UNPARSED", "EXCEPTION"]
    assert got[0]["ts"] is None and got[1]["message"].startswith("java.lang.IllegalArgumentException")


@pytest.mark.parametrize(
    "text,want",
    [
        ("2026-08-09T10:00:00.123456789Z", datetime(2026, 8, 9, 10, 0, 0, 123456)),
        ("2026-08-09T10:00:00+0300", datetime(2026, 8, 9, 7)),
        ("2026-08-09 10:00:00,5", datetime(2026, 8, 9, 10, 0, 0, 500000)),
        ("09.08.2026 10:00:00", datetime(2026, 8, 9, 10)),
        ("2026/08/09 10:00:00", datetime(2026, 8, 9, 10)),
        ("09/Aug/2026:10:00:00 +0300", datetime(2026, 8, 9, 7)),
        ("Aug  9 10:00:00", datetime(2026, 8, 9, 10)),
        ("1786269600", datetime(2026, 8, 9, 10)),
        ("1786269600123", datetime(2026, 8, 9, 10, 0, 0, 123000)),
        ("10:00:00.25", datetime(2026, 8, 9, 10, 0, 0, 250000)),
        ("2026-08-09 10:00:00+03:00", None),  # an offset after a space is no known shape
        ("soon", None),
        (None, None),
    ],
)
def test_timestamps(spark, text, want):
    assert spark.range(1).select(parse_timestamp(F.lit(text).cast("string"), "UTC", "2026-08-09").alias("t")).first()["t"] == want


def test_zone_of_local_times(spark):
    got = spark.range(1).select(parse_timestamp(F.lit("2026-08-09 10:00:00"), "Europe/Moscow", "2026-08-09").alias("t")).first()["t"]
    assert got == datetime(2026, 8, 9, 7)


def test_custom_format_comes_first(spark):
    parse = Parse(patterns=(CustomPattern("pipes", r"(?<ts>[^|]+)\|(?<level>\w+)\|(?<logger>[^|]+)\|(?<msg>.*)"),))
    r = spark.range(1).select(text_fields(F.lit("2026-08-09 10:00:00|WARN|a.B|hello"), parse).alias("f")).first()["f"]
    assert (r["pattern"], r["level"], r["logger"], r["message"]) == ("pipes", "WARN", "a.B", "hello")


def test_chain_and_headers(spark):
    lines = ["a.b.OuterException: one", "more", "\tat x.Y.z(Y.java:3)", "Caused by: InnerError", "\tat p.Q.r(Native Method)", "\t... 41 common frames omitted"]
    c = spark.range(1).select(exception_chain(F.array(*[F.lit(x) for x in lines])).alias("c")).first()["c"]
    assert [(x["type"], x["message"], x["omitted"], len(x["frames"])) for x in c] == [("a.b.OuterException", "one\nmore", 0, 1), ("InnerError", None, 41, 1)]
    heads = {"a.b.CException: x": True, "a.b.CTimeout": True, "CException: x": False, "some text Error": False, "Caused by: x": True, "": False}
    got = spark.createDataFrame([(k,) for k in heads], "x string").select("x", is_header(F.col("x")).alias("h")).collect()
    assert {r["x"]: r["h"] for r in got} == heads


def test_boundaries_against_a_plain_scan(spark):
    rnd = random.Random(1)
    rows, want = [], []
    for f in range(20):
        state, no = None, 0
        for i in range(1, 61):
            c = rnd.choice("JHPC")
            rows.append((f"f{f}", f, i, c, "x"))
            start = c in "HP" or (c == "J" and state != "H")
            if start:
                state, no = c, no + 1
            want.append((f"f{f}", i, no))
    df = spark.createDataFrame(rows, "source_file string, file_ord int, line_no int, cls string, line string").repartition(5)
    got = sorted((r["source_file"], r["line_no"], r["record_id"]) for r in record_starts(df).collect())
    assert got == sorted(want)


def test_limits(spark):
    text = "10:00:00 INFO a.B - x\n" + "more\n" * 5 + "10:00:01 INFO a.B - y\n10:00:02 INFO a.B - z\n"
    got = parse_lines(from_text(spark, text), Parse(default_date="2026-08-09", max_multiline_lines=3, max_events=2)).orderBy("seq").collect()
    assert [r["message"] for r in got] == ["x\nmore\nmore", "y"]


def test_files(spark, tmp_path):
    (tmp_path / "b.log").write_text("10:00:00 INFO a.B - привет\n", encoding="utf-8")
    (tmp_path / "a.txt").write_bytes(b"\xff\xfe broken")
    (tmp_path / "c.json").write_text("")
    paths = expand([str(tmp_path)], spark=spark)
    assert [p[-5:] for p in paths] == ["a.txt", "b.log", ".json"]
    lines, warnings = from_files(spark, paths)
    assert [r["line"] for r in lines.collect()] == ["10:00:00 INFO a.B - привет"]
    assert sorted(r["warning"] for r in warnings.collect()) == ["cannot be decoded as UTF-8", "empty file"]
    with pytest.raises(FileNotFoundError):
        expand([str(tmp_path / "none.log")], spark=spark)


def _trees(spark, *traces):
    rows = spark.createDataFrame([(i, t.split("\n")) for i, t in enumerate(traces)], "i int, lines array<string>").repartition(2)
    return [r["c"] for r in rows.select("i", exception_chain(F.col("lines")).alias("c")).orderBy("i").collect()]


def _shape(chain):
    """Types of the links, and of what each suppresses: (type, message, methods of its frames, omitted, parent, relation)."""
    below = lambda x: [(n["type"], n["message"], [f["method"] for f in n["frames"]], n["omitted"], n["parent"], n["relation"]) for n in x["suppressed"]]
    return [(x["type"], [f["method"] for f in x["frames"]], below(x)) for x in chain]


def test_suppressed_exceptions_keep_frames_and_causes(spark):
    nested = """a.OuterException: out
\tat a.A.run(A.java:1)
\tSuppressed: a.FirstException: one
\t\tat a.A.close(A.java:2)
\t\t... 3 more
\t\tSuppressed: a.SecondException
\t\t\tat a.B.close(B.java:3)
\t\tCaused by: a.RootError: disk
\t\t\tat a.C.write(C.java:4)
\t\t\tat a.C.flush(C.java:5)"""
    waiting = "a.OuterException: out\n\tSuppressed: a.FirstException: one\n\t\tat a.A.close(A.java:2)\ngoes on\n\tat a.A.run(A.java:1)\n\tSuppressed: a.ThirdException\nCaused by: a.RootError\n\tat a.C.write(C.java:4)"
    chain = "a.OuterException\n\tat a.A.run(A.java:1)\nCaused by: a.InnerException: in\n\tat a.B.run(B.java:1)\n\tSuppressed: a.FirstException\n\t\tat a.A.close(A.java:2)\nsomething else\n\tat a.Never.seen(N.java:1)"
    ended = "a.OuterException\n\tat a.A.run(A.java:1)\na.OtherException: begins\n\tat a.Never.seen(N.java:1)"
    n, w, c, e = _trees(spark, nested, waiting, chain, ended)
    assert _shape(n) == [("a.OuterException", ["run"], [("a.FirstException", "one", ["close"], 3, None, "suppressed"), ("a.SecondException", None, ["close"], 0, 0, "suppressed"), ("a.RootError", "disk", ["write", "flush"], 0, 1, "cause")])]
    assert _shape(w) == [("a.OuterException", ["run"], [("a.FirstException", "one", ["close"], 0, None, "suppressed"), ("a.ThirdException", None, [], 0, None, "suppressed"), ("a.RootError", None, ["write"], 0, 1, "cause")])]
    assert w[0]["message"] == "out\ngoes on"
    assert _shape(c) == [("a.OuterException", ["run"], []), ("a.InnerException", ["run"], [("a.FirstException", None, ["close"], 0, None, "suppressed")])]
    assert _shape(e) == [("a.OuterException", ["run"], [])]


def test_long_chains_and_odd_stacks(spark):
    many = "a.E0\n" + "\n".join(f"Caused by: a.E{i}" for i in range(1, 80))
    deep = "a.E0\n" + "\n".join("\t" * i + f"Suppressed: a.E{i}" for i in range(1, 80))
    m, d, none, blank = _trees(spark, many, deep, "", " \n\t")
    assert [x["type"] for x in m] == [f"a.E{i}" for i in range(64)] and not any(x["suppressed"] for x in m)
    assert [(x["type"], x["parent"]) for x in d[0]["suppressed"]] == [(f"a.E{i}", i - 2 if i > 1 else None) for i in range(1, 80)]
    assert none is None and blank is None


def test_rules_see_directly_suppressed_types_alone(spark):
    (n,) = _trees(spark, "a.Outer\n\tat a.A.run(A.java:1)\n\tSuppressed: a.First\n\t\tat a.A.run(A.java:1)\n\t\tSuppressed: a.Second")
    d = spark.createDataFrame([(n,)], f"exception array<{LINK}>")
    hit = lambda kind: d.where(matches(Condition(exceptionType=kind))).count()
    assert (hit("First"), hit("Second"), hit("Outer")) == (1, 0, 1)
