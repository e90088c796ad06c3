"""Text formats of log lines: ordered patterns, the first that matches a whole line wins."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Parse
from ..functions.let import let
from ..functions.levels import parse_level
from ..functions.text import nonblank
from ..functions.timestamps import parse_timestamp

#: The shapes of time stamps, the level words, and the formats, tried in this order.
STAMP = (
    r"(?:\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d{1,9})?(?:Z|[+-]\d{2}:?\d{2})?"
    r"|\d{2}[./]\d{2}[./]\d{4}[ T]\d{2}:\d{2}:\d{2}(?:[.,]\d{1,9})?"
    r"|\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}(?:[.,]\d{1,9})?"
    r"|\d{2}:\d{2}:\d{2}(?:[.,]\d{1,9})?)"
)
PREFIX = r"^\s*(?:\[)?(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}|\d{2}[./]\d{2}[./]\d{4}[T ]\d{2}:\d{2}:\d{2}|\d{2}:\d{2}:\d{2}|\d{13})"
LEVEL = r"(?:TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL|SEVERE|FINE|FINEST|CRITICAL)"
AT, LV = f"(?<ts>{STAMP})", f"(?<level>{LEVEL})"
THREAD = r"\[\s*(?<thread>[^\]]*?)\s*\]"
FORMATS = [
    ("spring-boot-sleuth", rf"^{AT}\s+{LV}\s+\[(?<sleuth>[^\]]*,[^\]]*)\]\s+(?<pid>\d+)?\s*---\s*{THREAD}\s+(?<logger>[^\s:]+)\s*:\s?(?<msg>.*)$"),
    ("spring-boot", rf"^{AT}\s+{LV}\s+(?<pid>\d+)?\s*---\s*(?:\[(?<app>[^\]\s][^\]]*)\]\s*)?{THREAD}\s*(?:\[(?<trace>[0-9a-fA-F,\-\s]*)\]\s*)?(?<logger>[^\s:]+)\s*:\s?(?<msg>.*)$"),
    ("logback", rf"^{AT}\s+(?:{THREAD}\s+)?{LV}\s+(?:\[\s*(?<trace>[0-9a-fA-F,\-]{{8,}})\s*\]\s+)?(?<logger>[\w.$#\[\]-]+)\s+[-:]\s(?<msg>.*)$"),
    ("level-first-thread", rf"^{AT}\s+{LV}\s+{THREAD}\s+(?<logger>[\w.$#-]+)\s*[-:]\s(?<msg>.*)$"),
    ("bracketed", rf"^\[{AT}\]\s*\[{LV}\]\s*(?:{THREAD}\s*)?(?:(?<logger>[\w.$#-]+)\s*[:-]\s*)?(?<msg>.*)$"),
    ("ts-level-logger", rf"^{AT}\s+{LV}\s+(?<logger>[\w.$#-]+)\s*[-:]\s(?<msg>.*)$"),
    ("ts-level", rf"^{AT}\s+{LV}\s+(?<msg>.*)$"),
    ("ts-only", rf"^{AT}\s+(?<msg>.*)$"),
]
GROUPS = ["ts", "level", "thread", "logger", "msg", "trace", "sleuth", "app", "pid"]
FIELDS = "struct<pattern:string,ts:timestamp,level:string,logger:string,thread:string,message:string,trace_id:string,span_id:string,service:string,pid:string>"


@dataclass(frozen=True)
class Format:
    name: str
    regex: str

    def index(self) -> dict[str, int]:
        """Group numbers by name."""
        plain = re.sub(r"\[[^\]]*\]", "x", re.sub(r"\\.", "x", self.regex))  # without escapes and character classes
        groups = re.findall(r"\((?:(?!\?)|\?<([A-Za-z]\w*)>)", plain)
        return {name: i + 1 for i, name in enumerate(groups) if name}


def formats(parse: Parse) -> list[Format]:
    own = [Format(p.name, p.regex) for p in parse.patterns]
    return own + [Format(n, r) for n, r in (FORMATS if parse.builtin_patterns else [])]


def may_start(line: Column) -> Column:
    """Lines that no format is tried on are sorted out first; this is part of the meaning, not only speed."""
    return line.startswith("[") | line.rlike(PREFIX)


def _fields(line: Column, f: Format, parse: Parse) -> Column:
    index = f.index()
    raw = {name: nonblank(F.regexp_extract(line, f.regex, index[name])) if name in index else F.lit(None).cast("string") for name in GROUPS}
    return let(F.struct(*[c.alias(n) for n, c in raw.items()]), lambda g: _named(line, g, f, parse))


def _named(line: Column, g: Column, f: Format, parse: Parse) -> Column:
    got = lambda name: g[name]
    sleuth, trace = F.split(got("sleuth"), ","), F.split(got("trace"), ",")
    usable = got("trace").isNotNull() & ~got("trace").startswith(",")
    three = F.size(sleuth) >= 3
    return F.struct(
        F.lit(f.name).alias("pattern"),
        parse_timestamp(got("ts"), parse.zone, parse.day()).alias("ts"),
        parse_level(got("level")).alias("level"),
        got("logger").alias("logger"),
        got("thread").alias("thread"),
        F.coalesce(got("msg"), line).alias("message"),
        F.coalesce(F.when(usable, nonblank(F.get(trace, 0))), F.when(three, nonblank(F.get(sleuth, 1)))).alias("trace_id"),
        F.coalesce(F.when(usable, nonblank(F.get(trace, 1))), F.when(three, nonblank(F.get(sleuth, 2)))).alias("span_id"),
        F.coalesce(F.when(three, nonblank(F.get(sleuth, 0))), got("app")).alias("service"),
        got("pid").alias("pid"),
    ).cast(FIELDS)


def matches(line: Column, parse: Parse) -> Column:
    hit = F.lit(False)
    for f in formats(parse):
        hit = hit | line.rlike(f"^(?:{f.regex})$")
    return may_start(line) & hit


def text_fields(line: Column, parse: Parse) -> Column:
    """Fields of the first format that matches, null if none does."""
    out = F.lit(None).cast(FIELDS)
    for f in reversed(formats(parse)):
        out = F.when(line.rlike(f"^(?:{f.regex})$"), _fields(line, f, parse)).otherwise(out)
    return F.when(may_start(line), out)
