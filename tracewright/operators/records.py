"""From lines to records to events.

Where a record starts is decided by windows over each file's lines; a record's lines are then gathered and read as one of
JSON, HTTP dump, formatted text or orphaned stack trace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Parse
from ..functions.events import default_kind
from ..functions.levels import parse_level
from ..functions.mining import EDGE_L, EDGE_R, duration_ms, http_summary, inline_http, last_id, pairs
from ..functions.stacks import exception_chain, is_header, is_stack_line
from ..schema import HTTP, LINES, LINK
from . import http_dump, json_records
from .scan import Running, running
from .text_patterns import matches, text_fields

IDS = ["trace_id", "span_id", "session_id", "request_id", "user_id"]
TEXTS = "array<string>"


def classify(lines: DataFrame, parse: Parse) -> DataFrame:
    """Adds cls: J a JSON object, H a dump's first line, P a formatted line, C anything else."""
    line = F.col("line")
    cls = F.when(json_records.json_object(line).isNotNull(), "J").when(http_dump.is_dump_start(line), "H").when(matches(line, parse), "P").otherwise("C")
    return lines.withColumn("cls", cls)


def record_starts(lines: DataFrame, block: Column | None = None) -> DataFrame:
    """Adds record_id (0 before the first record), start (this line starts it), orphan, and pos (place of the line in its record, from 1).

    A JSON line inside an HTTP dump is its body.  Before the first record a line of a stack trace starts one of its own.
    block: ranges of lines; then a file's lines go to many tasks, and what is open at the end of one range is handed to the next.
    """
    key, order = ["source_file"], [F.col("line_no")]
    cls, line = F.col("cls"), F.col("line")
    d = running(lines, key, order, {"opened": Running("before", F.when(cls.isin("H", "P"), cls))}, block)
    d = d.withColumn("start", cls.isin("H", "P") | ((cls == "J") & ~F.coalesce(F.col("opened") == "H", F.lit(False))))
    d = d.withColumn("stacky", (is_stack_line(line) | is_header(line)).cast("int"))
    d = running(d, key, order, {"earlier": Running("total", F.col("start").cast("int")), "stacks": Running("total", F.col("stacky"))}, block)
    # before any record the first line of a stack trace
    d = d.withColumn("orphan", (F.col("earlier") == 0) & (F.col("stacky") == 1) & (F.col("stacks") == 1)).withColumn("start", F.col("start") | F.col("orphan"))
    d = running(d, key, order, {"record_id": Running("total", F.col("start").cast("int")), "begun": Running("last", F.when(F.col("start"), F.col("line_no")))}, block)
    return d.withColumn("pos", F.col("line_no") - F.col("begun") + 1).drop("opened", "earlier", "stacky", "stacks", "begun")


def by_lines(parse: Parse) -> Column | None:
    return F.floor(F.col("line_no") / parse.block_lines) if parse.block_lines else None


def assemble(lines: DataFrame, parse: Parse) -> DataFrame:
    """One row a record: source_file, file_ord, line_no of its start, cls (O: orphan, U: unparsed line), block."""
    d = record_starts(classify(lines, parse), by_lines(parse))
    records = d.where((F.col("record_id") > 0) & (F.col("pos") <= parse.max_multiline_lines)).groupBy("source_file", "file_ord", "record_id").agg(
        F.min("line_no").alias("line_no"),
        F.max(F.when(F.col("start"), F.when(F.col("orphan"), "O").otherwise(F.col("cls")))).alias("cls"),
        F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("block"),
    )
    alone = d.where((F.col("record_id") == 0) & (F.trim("line") != "")).select("source_file", "file_ord", F.lit(0).cast("long").alias("record_id"), "line_no", F.lit("U").alias("cls"), F.array("line").alias("block"))
    return records.unionByName(alone)


def cut_records(lines: DataFrame, parse: Parse) -> DataFrame:
    """Warnings of records that are longer than a record may be, and of files with more events than are taken."""
    d = record_starts(classify(lines, parse), by_lines(parse))
    long = d.where("record_id > 0").groupBy("source_file", "record_id").agg(F.max("pos").alias("n"), F.min("line_no").alias("at")).where(F.col("n") > parse.max_multiline_lines)
    found = long.select("source_file", F.format_string("record at line %d cut after %d lines", "at", F.lit(parse.max_multiline_lines)).alias("warning"))
    if parse.max_events <= 0:
        return found
    # the limit is noticed when a further record begins, or at once if the last event taken is a line that is no record
    loose = F.count_if((F.col("record_id") == 0) & (F.trim("line") != ""))
    counts = d.groupBy("source_file").agg(loose.alias("loose"), F.max("record_id").alias("records"))
    over = counts.where((F.col("loose") >= parse.max_events) | (F.col("loose") + F.col("records") > parse.max_events))
    return found.unionByName(over.select("source_file", F.lit(f"the limit of {parse.max_events} events is reached, later lines are left out").alias("warning")))


def _put(attributes: Column, key: str, value: Column) -> Column:
    rest = F.map_filter(attributes, lambda k, v: k != key)
    return F.when(value.isNotNull(), F.map_concat(rest, F.create_map(F.lit(key), value))).otherwise(attributes)


def guess_level(exception: Column, http: Column, message: Column) -> Column:
    word = F.regexp_extract(F.left(message, F.lit(200)), EDGE_L + r"(FATAL|ERROR|WARN(?:ING)?|INFO|DEBUG|TRACE|SEVERE)" + EDGE_R, 1)
    return F.when(exception.isNotNull() | F.coalesce(http["status"] >= 400, F.lit(False)), "ERROR").when(word != "", parse_level(word)).otherwise("INFO")


def _tail(d: DataFrame) -> DataFrame:
    """Lines after a record's first: message lines, then a stack trace."""
    tail = F.when(F.col("cls").isin("J", "P", "O"), F.slice("block", 2, F.greatest(F.size("block") - 1, F.lit(0)))).otherwise(F.array().cast(TEXTS))
    d = d.withColumn("tail", tail)
    marks = F.transform("tail", lambda x: is_stack_line(x) | is_header(x))
    d = d.withColumn("stack_at", F.coalesce(F.array_position(marks, True), F.lit(0)))
    said = F.when(F.col("stack_at") > 0, F.slice("tail", 1, F.greatest(F.col("stack_at").cast("int") - 1, F.lit(0)))).otherwise(F.col("tail"))
    more = F.array_join(F.filter(said, lambda x: F.trim(x) != ""), "\n")
    d = d.withColumn("message", F.when(more == "", F.col("message")).when(F.coalesce(F.col("message"), F.lit("")) == "", more).otherwise(F.concat("message", F.lit("\n"), more)))
    stack = F.when(F.col("stack_at") > 0, F.slice("tail", F.col("stack_at").cast("int"), F.size("tail")))
    last = F.element_at(F.split("message", r"\r\n|\r|\n"), -1)
    stack = F.when(~is_header(F.get(stack, 0)) & is_header(last), F.concat(F.array(last), stack)).otherwise(stack)
    return d.withColumn("stack", stack).withColumn("exception", F.coalesce(exception_chain(F.col("stack")), F.col("exception"))).drop("tail", "stack_at", "stack")


def _mined(d: DataFrame, parse: Parse) -> DataFrame:
    """Ids and durations of the texts; the last pair of a key wins, whatever the fields said before."""
    none = F.array().cast("array<struct<k:string,v:string>>")
    dump = F.when(F.col("cls") == "H", F.col("http"))
    heads = F.transform(F.col("headers"), lambda h: F.concat(h["name"], F.lit("="), h["value"]))
    of_dump = F.concat(F.coalesce(pairs(dump["body"]), none), F.coalesce(F.flatten(F.transform(heads, pairs)), none))
    of_json = F.when(F.col("cls") == "J", F.coalesce(pairs(F.col("own_message")), none)).otherwise(none)
    of_text = F.coalesce(pairs(F.col("message")), none) if parse.extract_from_message else none
    d = d.withColumn("found", F.when(F.col("cls") == "U", none).otherwise(F.concat(of_dump, of_json, of_text)))
    for name in IDS:
        d = d.withColumn(name, F.coalesce(F.nullif(F.trim(last_id(F.col("found"), name)), F.lit("")), F.col(name)))
    head_times = F.try_element_at(F.filter(F.transform(heads, duration_ms), lambda x: x.isNotNull()), F.lit(-1))
    times = [duration_ms(F.col("message"))] if parse.extract_from_message else []
    took = F.coalesce(*times, head_times, duration_ms(dump["body"]), F.when(F.col("cls") == "J", duration_ms(F.col("own_message"))))
    d = d.withColumn("attributes", _put(F.col("attributes"), "durationMs", F.when(F.col("cls") != "U", took.cast("string"))))
    if parse.extract_from_message:
        d = d.withColumn("http", F.coalesce(F.col("http"), F.when(~F.col("cls").isin("U", "H"), inline_http(F.col("message")))))
    return d.drop("found")


def read_records(records: DataFrame, parse: Parse, *more: str) -> DataFrame:
    """Events of assembled records; timestamps as the records themselves have them.  more: columns that come along."""
    line, cls = F.get("block", 0), F.col("cls")
    d = records.withColumn("p", F.when(cls == "P", text_fields(line, parse))).withColumn("object", F.when(cls == "J", json_records.json_object(line)))
    d = d.withColumn("values", json_records.scalars(F.col("object"))).withColumn("said", json_records.context(F.col("values")))
    j = json_records.json_fields(F.col("values"), F.col("said"), parse.zone, parse.day())
    d = d.withColumn("dump", F.when(cls == "H", http_dump.parse_dump(F.col("block")))).withColumn("headers", F.when(cls == "H", http_dump.headers(F.col("block"))))
    p, empty = F.col("p"), F.create_map().cast("map<string,string>")
    pick = lambda name: F.when(cls == "J", j[name]).when(cls == "P", p[name]) if name in ("trace_id", "span_id", "service", "logger", "thread", "level", "ts") else F.when(cls == "J", j[name])
    d = d.select(
        *["source_file", "file_ord", "line_no", "cls", "block", "headers", *more],
        pick("ts").alias("ts"),
        F.coalesce(F.when(cls == "O", "ERROR").when(cls == "U", "UNKNOWN"), pick("level"), F.lit("UNKNOWN")).alias("level"),
        *[pick(n).alias(n) for n in ("logger", "thread", "service", *IDS)],
        F.when(cls == "J", j["message"]).when(cls == "P", p["message"]).when(cls == "H", http_summary(F.col("dump"))).when(cls == "O", F.trim(line)).otherwise(line).alias("message"),
        F.when(cls == "J", j["exception"]).cast(f"array<{LINK}>").alias("exception"),
        F.when(cls == "J", j["http"]).when(cls == "H", F.col("dump")).cast(HTTP).alias("http"),
        F.when(cls == "J", j["attributes"]).when(p["pid"].isNotNull(), F.create_map(F.lit("pid"), p["pid"])).otherwise(empty).alias("attributes"),
    ).withColumn("own_message", F.col("message"))
    d = _tail(d)
    failed = F.coalesce(F.col("http.status") >= 400, F.lit(False))
    guessed = F.when(cls == "H", F.when(failed, "ERROR").otherwise("INFO")).otherwise(guess_level(F.col("exception"), F.col("http"), F.col("message")))
    d = d.withColumn("level", F.when((F.col("level") == "UNKNOWN") & (cls != "U"), guessed).otherwise(F.col("level")))
    fixed = F.when(cls == "U", "UNPARSED").when((cls == "H") & F.col("http.status").isNotNull(), "HTTP_RESPONSE").when(cls == "H", "HTTP_REQUEST")
    d = _mined(d, parse).withColumn("kind", default_kind(fixed, F.col("exception"), F.col("http")))
    return d.select(
        (F.col("file_ord").cast("long") * LINES + F.col("line_no")).alias("seq"),
        *["ts", "level", "logger", "thread", "message", *IDS, "service", "exception", "http", "kind", "attributes", "source_file"],
        F.col("line_no").cast("int").alias("source_line"),
        F.array_join("block", "\n").alias("raw"),
        *more,
    )


def inherit_timestamps(events: DataFrame, block_lines: int = 0) -> DataFrame:
    """Undated records take the last own timestamp before them, across files; unparsed lines stay undated."""
    d = events.withColumn("ord", F.floor(F.col("seq") / LINES))
    own = F.when(F.col("kind") != "UNPARSED", F.col("ts"))
    # what a file passes on: one row a file, so the window over them is small
    ends = d.groupBy("ord").agg(F.max_by(F.col("ts"), F.when(F.col("ts").isNotNull() & (F.col("kind") != "UNPARSED"), F.col("seq"))).alias("end"))
    ends = ends.withColumn("carried", F.last("end", ignorenulls=True).over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))).select("ord", "carried")
    d = running(d, ["ord"], [F.col("seq")], {"inside": Running("last", own)}, F.floor(F.col("seq") / block_lines) if block_lines else None)
    d = d.join(ends, "ord").withColumn("known", F.coalesce("inside", "carried"))
    return date_late(d, "known").select(*events.columns)


def date_late(events: DataFrame, known: str) -> DataFrame:
    """Undated records take the time of the column `known`, which goes."""
    late = F.col("ts").isNull() & (F.col("kind") != "UNPARSED") & F.col(known).isNotNull()
    d = events.withColumn("attributes", F.when(late, _put(F.col("attributes"), "timestampInherited", F.lit("true"))).otherwise(F.col("attributes")))
    return d.withColumn("ts", F.when(late, F.col(known)).otherwise(F.col("ts"))).drop(known)


def first_events(events: DataFrame, most: int, block_lines: int = 0) -> DataFrame:
    """The first `most` events of each file."""
    block = F.floor(F.col("seq") / block_lines) if block_lines else None
    return running(events, ["source_file"], [F.col("seq")], {"nth": Running("total", F.lit(1))}, block).where(F.col("nth") <= most).drop("nth")


def parse_lines(lines: DataFrame, parse: Parse = Parse()) -> DataFrame:
    """Events of numbered lines (source_file, file_ord, line_no, line)."""
    events = read_records(assemble(lines, parse), parse)
    if parse.max_events > 0:  # an event never depends on a later one, so the rest need not be read
        events = first_events(events, parse.max_events, parse.block_lines)
    return inherit_timestamps(events, parse.block_lines)
