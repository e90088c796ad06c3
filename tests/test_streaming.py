"""Streams that are run: two batches with a restart between give the rows of the batch engine."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracewright.config import Correlation, Parse
from tracewright.operators.correlate import with_context
from tracewright.operators.records import parse_lines
from tracewright.sources.files import from_text
from tracewright.streaming.assembly import ROCKSDB, stream_context, stream_events

PARSE = Parse(default_date="2026-01-01", max_multiline_lines=4)
TEXT = """loose line
java.lang.Error: early
\tat a.B.c(B.java:1)
10:00:00 INFO a.B - first userId=7
more
{"@timestamp":"2026-01-01T10:00:02Z","level":"warn","message":"json"}
GET /x HTTP/1.1
Host: h

{"level":"error","message":"a body"}
10:00:05 ERROR a.B - failed
java.lang.IllegalStateException: bad
\tat a.B.c(B.java:2)
\tat a.B.d(B.java:3)
\tat a.B.e(B.java:4)
HTTP/1.1 502 Bad Gateway

gone
10:00:09 WARN a.B - last
"""
COLUMNS = ["seq", "ts", "level", "logger", "message", "user_id", "exception", "http", "kind", "attributes", "raw"]


@pytest.fixture
def states(spark):
    conf = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v else spark.conf.unset(k)


def streamed(spark, folder, schema, build, parts):
    """Each part is one batch of a query of its own, which goes on from the checkpoint."""
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        live = spark.readStream.schema(schema).parquet(f"{folder}/in")
        q = build(live).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert not q.isActive, i
    return spark.read.parquet(f"{folder}/out")


def test_records_of_two_batches(spark, tmp_path, states):
    one, two = from_text(spark, TEXT, "one"), from_text(spark, TEXT, "two").withColumn("file_ord", F.lit(1))
    lines = one.union(two).withColumn("line_no", F.col("line_no").cast("long"))
    want = {r["seq"]: r for r in parse_lines(lines.where("file_ord = 0"), PARSE).select(*COLUMNS).collect()}
    # the cut lies in a dump of one file, in a stack trace of the other
    early = (F.col("line_no") <= 8) & (F.col("file_ord") == 0) | (F.col("line_no") <= 13) & (F.col("file_ord") == 1)
    got = streamed(spark, tmp_path, lines.schema, lambda d: stream_events(d, PARSE, idle_seconds=3600), [lines.where(early), lines.where(~early)]).select(*COLUMNS).cache()
    last = max(want)  # it is open until its file has been still
    assert {r["seq"]: r for r in got.where("seq < 1000").collect()} == {k: v for k, v in want.items() if k != last}
    assert got.count() == 2 * (len(want) - 1)


def test_a_still_file_gives_its_last_record(spark, tmp_path, states):
    lines = from_text(spark, TEXT, "one").withColumn("line_no", F.col("line_no").cast("long"))
    later = from_text(spark, "10:00:00 INFO a.B - x\n", "other").withColumn("line_no", F.col("line_no").cast("long"))
    got = streamed(spark, tmp_path, lines.schema, lambda d: stream_events(d, PARSE, idle_seconds=0), [lines, later])
    assert got.where("source_file = 'one' AND message = 'last'").count() == 1


def test_traces_and_requests_of_threads(spark, tmp_path, states):
    at = lambda s: datetime(2026, 1, 1) + timedelta(seconds=s)
    rows = [(0, at(0), "a", "t1", None), (1, at(5), "a", None, None), (2, at(14), "a", None, None), (3, at(30), "a", None, None), (4, at(31), "a", None, "r1"), (5, at(40), "a", None, None), (6, at(41), "b", None, None), (7, at(45), "a", None, None), (8, at(60), "a", None, None)]
    events = spark.createDataFrame(rows, "seq long, ts timestamp, thread string, trace_id string, request_id string")
    settings = Correlation(inherit_window_seconds=10)
    want = {r["seq"]: (r["corr"] and tuple(r["corr"])) for r in with_context(events, settings).collect()}
    got = streamed(spark, tmp_path, events.schema, lambda d: stream_context(d, settings), [events.where("seq < 6"), events.where("seq >= 6")])
    assert {r["seq"]: (r["corr_kind"] and (r["corr_kind"], r["corr_key"])) for r in got.collect()} == want
    assert want[2] == ("TRACE", "t1") and want[3] is None and want[7] == ("REQUEST", "r1") and want[8] is None
