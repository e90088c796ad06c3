"""Scans in blocks give what plain windows give, on random rows; and so does the whole chain from lines to causes."""

import random
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracewright.config import Analysis, Config, Correlation, Parse, Timeline
from tracewright.operators.correlate import by_time, correlate, in_time
from tracewright.operators.records import classify, parse_lines, record_starts
from tracewright.operators.rootcause import root_causes
from tracewright.operators.scan import Running, cuts, running, whole
from tracewright.operators.timeline import build_entries
from tracewright.rules.compile import apply_rules
from tracewright.rules.model import parse_rules
from tracewright.sources.files import from_text


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(3)
    out = []
    for seq in range(600):
        key = rnd.choice(["hot"] * 6 + ["a", "b", None])
        ts = None if rnd.random() < 0.1 else datetime(2026, 1, 1) + timedelta(seconds=rnd.randrange(4000))
        out.append((seq, key, ts, rnd.choice([None, None, 1, 2, 3])))
    return spark.createDataFrame(out, "seq long, key string, ts timestamp, v int").repartition(5).cache()


def test_running_values(rows):
    values = {k: Running(k, F.col("v")) for k in ("total", "last", "before", "previous", "following", "first")}
    plain = running(rows, ["key"], in_time(), values)
    for seconds in (60, 700, 100_000):
        assert rows_of(running(rows, ["key"], in_time(), values, by_time(seconds)).select(*plain.columns)) == rows_of(plain)


@pytest.mark.parametrize("limit", [5, 40, 400])
def test_cuts_and_what_stays_alive(rows, limit):
    longer = lambda now, before: now["us"] - before["us"] > limit * 1_000_000
    made = lambda block: cuts(rows, ["key"], in_time(), longer, {"us": F.unix_micros("ts")}, block, "n", ("alive", F.col("v")))
    plain = made(None)
    for seconds in (20, 700, 100_000):
        assert rows_of(made(by_time(seconds))) == rows_of(plain)
    # and the plain one against a loop
    by_key = {}
    for r in sorted(rows.collect(), key=lambda r: (r["ts"] is None, r["ts"] or datetime.min, r["seq"])):
        by_key.setdefault(r["key"], []).append(r)
    want = []
    for own in by_key.values():
        n, alive, before = 0, None, None
        for r in own:
            if before is not None and r["ts"] is not None and (r["ts"] - before).total_seconds() > limit:
                n, alive = n + 1, None
            alive, before = (r["v"] if r["v"] is not None else alive), r["ts"]
            want.append((r["seq"], n, alive))
    assert sorted((r["seq"], r["n"], r["alive"]) for r in plain.collect()) == sorted(want)


def test_whole_keys(rows):
    values = {"n": F.count(F.lit(1)), "most": F.max("v")}
    assert rows_of(whole(rows, ["key"], values, True)) == rows_of(whole(rows, ["key"], values, False))


RULES = parse_rules("""
rules:
- {name: after-warning, priority: 95, when: {levelAtLeast: ERROR}, precededBy: {withinSeconds: 30, when: {level: WARN}}, annotate: [{type: RETRY, label: after a warning}], cause: {title: After a warning, confidence: 0.7}}
- {name: ever, priority: 60, when: {level: INFO}, precededBy: {withinSeconds: 0, when: {level: ERROR}}, annotate: [{type: WARNING, label: after an error}]}
""")


def log(n, seed):
    """Lines on few threads: traces now and then, repeats, pauses, requests with answers, errors, and lines without a time."""
    rnd, at, out = random.Random(seed), datetime(2026, 1, 1, 10), []
    for i in range(n):
        at += timedelta(seconds=rnd.choice([0, 0, 1, 2, 9, 40]))
        trace = f"[{rnd.choice(['abcdef0123456789', '0123456789abcdef'])}] " if rnd.random() < 0.2 else ""
        level = rnd.choice(["INFO", "INFO", "WARN", "ERROR", "DEBUG"])
        out.append(f"{at:%Y-%m-%d %H:%M:%S},000 [t{rnd.choice([1, 1, 1, 2])}] {level} {trace}a.B - {rnd.choice(['same', 'same', 'other', f'number {i}'])}")
        if rnd.random() < 0.1:
            out += ["java.lang.IllegalStateException: bad", "\tat a.B.c(B.java:1)"]
        if rnd.random() < 0.15:
            out += ["GET /x HTTP/1.1", "Host: h", "", '{"a": 1}'] if rnd.random() < 0.5 else ["HTTP/1.1 502 Bad Gateway", "", "gone"]
    return "\n".join(out) + "\n"


def test_lines_to_causes(spark):
    """FILE and THREAD groups alike: nothing changes when no task sees a whole file, thread or timeline."""
    lines = from_text(spark, "java.lang.Error: early\n\tat a.B.c(B.java:1)\nloose\n" + log(140, 1))
    plain = Config(parse=Parse(default_date="2026-01-01"), timeline=Timeline(dedup_window_seconds=20))
    blocks = replace(
        plain, parse=replace(plain.parse, block_lines=17), correlation=Correlation(block_seconds=25), timeline=replace(plain.timeline, block_seconds=35, block_entries=9), analysis=Analysis(block_entries=7)
    )
    starts = lambda block: record_starts(classify(lines, plain.parse), block)
    columns = starts(None).columns
    assert rows_of(starts(F.floor(F.col("line_no") / 5)).select(*columns)) == rows_of(starts(None))

    events = parse_lines(lines, plain.parse).cache()

    def stages(c):
        yield correlate(events, c.correlation)
        # most rows fall to one FILE group
        corr = correlate(events, replace(c.correlation, priority=("TRACE",), min_events_per_timeline=4)).cache()
        yield corr
        ruled = apply_rules(build_entries(corr, c.timeline), RULES, c.timeline.block_entries).cache()
        yield ruled
        yield root_causes(ruled, RULES, c.analysis)

    for a, b in zip(stages(plain), stages(blocks), strict=True):
        assert a.count() > 3 and rows_of(b.select(*a.columns)) == rows_of(a)
