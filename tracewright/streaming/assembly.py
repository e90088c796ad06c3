"""Structured Streaming of raw lines: records put together across micro-batches, and the trace or request of a thread.

Both keep their state in state variables of transformWithState (spark.sql.streaming.stateStore.providerClass must be
the RocksDB provider), so a restart from the checkpoint goes on where it stopped, in the middle of a record if need be.  All
parsing is done by the batch engine's own column expressions, before and behind the stateful step.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import Correlation, Parse
from ..functions.stacks import is_header, is_stack_line
from ..operators.correlate import own_key
from ..operators.json_records import json_object, json_time, scalars
from ..operators.records import classify, date_late, read_records
from ..operators.text_patterns import text_fields

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RECORD = "source_file string, file_ord int, record_id long, line_no long, cls string, block array<string>, inherited timestamp"
#: record_id, first line, class and lines of the open record; class of the last H or P line; whether a stack line was met; last own time in microseconds.
STATE = "record_id long, line_no long, sort string, block array<string>, opened string, stacks boolean, us long, own_us long"


class Assembler(StatefulProcessor):
    """Lines of a file, in their order, into records; the open record stays in the state, its first `most` lines of it."""

    def __init__(self, most: int, idle_ms: int):
        self.most, self.idle_ms = most, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", STATE)

    @staticmethod
    def _made(file: str, file_ord: int, s: list, found: list) -> None:
        """Close the record that is open, if there is one."""
        record_id, line_no, cls, block, opened, stacks, us, own_us = s
        if block:
            found.append((file, file_ord, record_id, line_no, cls, list(block), us))
            s[6] = own_us if own_us is not None else us
        s[1:4], s[7] = [0, "", []], None

    def _frame(self, found: list) -> Any:
        import pandas as pd

        d = pd.DataFrame(found, columns=[c.split()[0] for c in RECORD.split(", ")])
        d["inherited"] = pd.to_datetime(d["inherited"], unit="us")
        return d

    def handleInputRows(self, key: Any, rows: Iterator[Any], timerValues: Any) -> Iterator[Any]:
        import pandas as pd

        s = list(self.state.get()) if self.state.exists() else [0, 0, "", [], None, False, None, None]
        s[3] = list(s[3] or [])
        found: list[tuple] = []
        file_ord = arrived = 0
        for r in pd.concat(list(rows)).sort_values("line_no").itertuples(index=False):
            arrived = max(arrived, int(r.arrived_ms))
            file_ord = int(r.file_ord)
            start = r.sort in ("H", "P") or (r.sort == "J" and s[4] != "H")
            orphan = not start and s[0] == 0 and r.stacky and not s[5]
            s[5] = s[5] or bool(r.stacky)
            if start or orphan:
                self._made(key[0], file_ord, s, found)
                s[:4], s[7] = [s[0] + 1, int(r.line_no), "O" if orphan else r.sort, [r.line]], None if pd.isna(r.us) else int(r.us)
            elif s[0] == 0:
                if r.line.strip():
                    found.append((key[0], file_ord, 0, int(r.line_no), "U", [r.line], None))
            elif len(s[3]) < self.most and s[3]:
                s[3].append(r.line)
            if r.sort in ("H", "P"):
                s[4] = r.sort
        self.state.update(tuple(s))
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        if s[3]:
            self.handle.registerTimer(arrived + self.idle_ms)
        if found:
            yield self._frame(found)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Any]:
        """A file that is still: its last record is complete.  Lines that come later are left out until a record begins."""
        s, found = list(self.state.get()), []
        s[3] = list(s[3] or [])
        self._made(key[0], 0, s, found)
        self.state.update(tuple(s))
        if found:
            yield self._frame(found)

    def close(self) -> None:
        pass


def stream_records(lines: DataFrame, parse: Parse = Parse(), idle_seconds: int = 60) -> DataFrame:
    """Records of a stream of (source_file, file_ord, line_no, line); a file's lines must come in order, batch after batch.

    A record is given when the next one begins, or when lines of any file have come `idle_seconds` after its own file's last.
    That goes by a column `arrived` (timestamp); where there is none it is the time of the batch.
    """
    lines = lines if "arrived" in lines.columns else lines.withColumn("arrived", F.current_timestamp())
    d = classify(lines, parse).withColumn("values", scalars(F.when(F.col("cls") == "J", json_object(F.col("line")))))
    line, cls = F.col("line"), F.col("cls")
    at = F.when(cls == "P", text_fields(line, parse)["ts"]).when(cls == "J", json_time(F.col("values"), parse.zone, parse.day()))
    d = d.select("source_file", F.col("file_ord").cast("int"), F.col("line_no").cast("long").alias("line_no"), "line", cls.alias("sort"), (is_stack_line(line) | is_header(line)).alias("stacky"), F.unix_micros(at).alias("us"), "arrived", F.unix_millis("arrived").alias("arrived_ms"))
    d = d.withWatermark("arrived", "0 seconds")
    return d.groupBy("source_file").transformWithStateInPandas(Assembler(parse.max_multiline_lines, idle_seconds * 1000), RECORD, "Append", "EventTime")


def stream_events(lines: DataFrame, parse: Parse = Parse(), idle_seconds: int = 60) -> DataFrame:
    """Events of a stream of lines, undated ones with the last time of their own file."""
    return date_late(read_records(stream_records(lines, parse, idle_seconds), parse, "inherited"), "inherited")


CONTEXT = "seq long, ts timestamp, thread string, corr_kind string, corr_key string"


class ThreadContext(StatefulProcessor):
    """The trace or request that is alive in a thread; forgotten when event time has passed the window."""

    def __init__(self, window_us: int):
        self.window_us = window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("alive", "kind string, name string, us long")

    def handleInputRows(self, key: Any, rows: Iterator[Any], timerValues: Any) -> Iterator[Any]:
        import pandas as pd

        kind, name, last = self.state.get() if self.state.exists() else (None, None, None)
        found = []
        d = pd.concat(list(rows)).sort_values(["ts", "seq"], na_position="last")
        for r in d.itertuples(index=False):
            us = None if pd.isna(r.ts) else r.ts.value // 1000 if r.ts.unit == "ns" else int(r.ts.asm8.astype("datetime64[us]").astype("int64"))
            if us is not None and last is not None and us - last > self.window_us:
                kind = name = None
            if r.kind is not None:
                kind, name = r.kind, r.name
            last = us
            found.append((r.seq, r.ts, key[0], kind, name))
        self.state.update((kind, name, last))
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        if last is not None:
            self.handle.registerTimer(last // 1000 + self.window_us // 1000 + 1)
        yield pd.DataFrame(found, columns=[c.split()[0] for c in CONTEXT.split(", ")])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Any]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_context(events: DataFrame, settings: Correlation = Correlation(), late: str = "1 minute") -> DataFrame:
    """seq, ts, thread and the trace or request that each row of a thread belongs to, its own or the one alive; undated rows close a batch's time order.

    Events of a thread must come in time order up to the watermark's delay, as rows of one batch are sorted, but batches are not.
    """
    d = events.where("thread IS NOT NULL").withColumn("own", own_key(settings)).select("thread", "seq", "ts", F.col("own.kind").alias("kind"), F.col("own.key").alias("name"))
    d = d.withWatermark("ts", late).groupBy("thread")
    return d.transformWithStateInPandas(ThreadContext(settings.inherit_window_seconds * 1_000_000), CONTEXT, "Append", "EventTime")
