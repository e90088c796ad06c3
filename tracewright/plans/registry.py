"""Queries over the given tables, each with its SQL counterpart where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Analysis as AnalysisSettings
from ..config import Config, Correlation, Parse, Timeline
from ..functions.fingerprint import normalize
from ..functions.levels import parse_level
from ..functions.mining import duration_ms, inline_http, last_id, pairs
from ..functions.text import format_duration, short_logger, shortened
from ..functions.timestamps import parse_timestamp
from ..operators.correlate import correlate
from ..operators.filters import filter_events, filter_timelines
from ..operators.http_dump import parse_dump
from ..operators.json_records import context, json_fields, json_object, scalars
from ..operators.records import classify, guess_level, inherit_timestamps, parse_lines, record_starts
from ..operators.rootcause import app_frame, frame_text, root_causes
from ..operators.rootcause import incidents as failed_timelines
from ..operators.text_patterns import text_fields
from ..operators.timeline import build_entries, timelines
from ..rules.compile import apply_rules, rule_hits
from ..rules.model import parse_rules
from ..functions.stacks import exception_chain
from ..schema import LINES
from .adapter import SQL, log_events, log_lines, raw_events
from .analysis import event_summary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Wider than the defaults, as the events table has a few rows a user and day.
SETTINGS = Config(correlation=Correlation(thread_gap_seconds=21_600, inherit_window_seconds=7_200), timeline=Timeline(dedup_window_seconds=864_000, suspicious_gap_seconds=3_600), analysis=AnalysisSettings())
RULES = """
rules:
- {name: error-after-warning, priority: 95, when: {levelAtLeast: ERROR}, precededBy: {withinSeconds: 7200, when: {level: WARN}}, annotate: [{type: RETRY, label: after a warning}], cause: {title: Error after a warning, confidence: 0.7}}
- {name: timeout, priority: 85, when: {exceptionType: SocketTimeoutException}, annotate: [{type: TIMEOUT, label: timeout}], cause: {title: Remote service too slow, confidence: 0.85}}
- {name: server-error, priority: 65, when: {httpStatusClass: 5xx}, annotate: [{type: HTTP_SERVER_ERROR, label: server error}], cause: {title: Server error, confidence: 0.7}, stopOnMatch: true}
- {name: slow, priority: 20, when: {minDurationMs: 3000}, annotate: [{type: SLOW, label: slow}]}
"""


def query(sql: str | None = None) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


US = "epoch_us(ts) AS ts_us"
INHERIT, GAP, DEDUP = 7_200_000_000, 21_600_000_000, 864_000_000_000
#: own id, thread context, session, thread group; then entries of merged repeats.
CORR = f"""{SQL},
o AS (SELECT *, CASE WHEN trace_id IS NOT NULL THEN 'TRACE' END AS own, epoch_us(ts) AS us FROM ev),
sg AS (SELECT *, sum(pause) OVER (PARTITION BY thread ORDER BY us, seq) AS seg FROM (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY thread ORDER BY us, seq) > {INHERIT} THEN 1 ELSE 0 END AS pause FROM o)),
cx AS (SELECT *, last_value(trace_id IGNORE NULLS) OVER (PARTITION BY thread, seg ORDER BY us, seq) AS active FROM sg),
lf AS (SELECT *, active IS NULL AND session_id IS NULL AS loose FROM cx),
tg AS (SELECT *, 1 + sum(cut) OVER (PARTITION BY thread, loose ORDER BY us, seq) AS nth FROM (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY thread, loose ORDER BY us, seq) > {GAP} THEN 1 ELSE 0 END AS cut FROM lf)),
co AS (SELECT *, CASE WHEN active IS NOT NULL THEN 'TRACE' WHEN session_id IS NOT NULL THEN 'SESSION' ELSE 'THREAD' END AS corr_kind,
  coalesce(active, session_id, CASE WHEN nth > 1 THEN thread || '#' || nth ELSE thread END) AS corr_key FROM tg)"""
ENTRIES = f"""{CORR},
fp AS (SELECT *, concat_ws('|', level, logger, regexp_replace(message, '[0-9]+', '<n>', 'g'), coalesce(exc, '-'), coalesce(method, '-'), coalesce(status::VARCHAR, '-')) AS print FROM co),
fr AS (SELECT *, CASE WHEN lag(print) OVER w = print AND us - lag(us) OVER w <= {DEDUP} THEN 0 ELSE 1 END AS fresh FROM fp WINDOW w AS (PARTITION BY corr_kind, corr_key ORDER BY us, seq)),
nr AS (SELECT *, sum(fresh) OVER (PARTITION BY corr_kind, corr_key ORDER BY us, seq)::INT AS entry_no FROM fr),
gr AS (SELECT corr_kind, corr_key, entry_no, arg_min(nr, (us, seq)) AS e, count(*)::INT AS repeat_count, max(us) AS last_us FROM nr GROUP BY ALL),
en AS (SELECT corr_kind, corr_key, entry_no, repeat_count, last_us, e.seq AS seq, e.us AS us, e.level AS level, e.message AS message, e.kind AS kind, e.exc AS exc, e.status AS status, e.method AS method, e.ms AS ms, e.is_error AS is_error, e.service AS service FROM gr),
nt AS (SELECT *, (us - first_value(us) OVER w) // 1000 AS since_start_ms, (us - lag(last_us) OVER w) // 1000 AS since_previous_ms FROM en WINDOW w AS (PARTITION BY corr_kind, corr_key ORDER BY entry_no))"""


@query(f"WITH {SQL} SELECT level, count(*) AS n, count(*) FILTER (is_error) AS errors, count(*) FILTER (exc IS NOT NULL) AS exceptions FROM ev GROUP BY level")
def level_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = raw_events(spark, sf_dir)
    bad = (F.col("level") == "ERROR") | F.col("exc").isNotNull() | F.coalesce(F.col("status") >= 500, F.lit(False))
    return d.groupBy("level").agg(F.count("*").alias("n"), F.count_if(bad).alias("errors"), F.count("exc").alias("exceptions"))


@query(f"WITH {SQL} SELECT count(*) AS total_events, count(*) FILTER (is_error) AS error_events, count(*) FILTER (level = 'WARN' AND NOT is_error) AS warning_events, count(*) FILTER (exc IS NOT NULL) AS exception_events FROM ev")
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_summary(log_events(spark, sf_dir))


@query(f"WITH {SQL} SELECT seq, level, {US} FROM ev WHERE ts >= '2024-01-10' AND ts <= '2024-01-20 12:00:00' AND level IN ('WARN', 'ERROR')")
def filter_time_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = filter_events(log_events(spark, sf_dir), "2024-01-10", "2024-01-20 12:00:00", "WARN")
    return d.select("seq", "level", F.unix_micros("ts").alias("ts_us"))


def _parsed(form: str, columns: dict[str, str]) -> None:
    """A round trip: lines of one format, read back; SQL takes the columns they were made from."""
    sql = ", ".join(f"{v} AS {k}" for k, v in columns.items())

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = log_lines(spark, sf_dir, form).select("seq", text_fields(F.col("line"), Parse(default_date="2024-01-01")).alias("f")).select("seq", "f.*")
        return d.select("seq", F.floor(F.unix_micros("ts") / 1000).cast("long").alias("ts_ms"), *[F.col(c) for c in columns if c not in ("seq", "ts_ms")])

    run.__name__ = "parse_" + form.replace("-", "_")
    query(f"WITH {SQL} SELECT seq, epoch_us(ts) // 1000 AS ts_ms, {sql} FROM ev")(run)


BASE = {"level": "level", "logger": "logger", "thread": "thread", "message": "message"}
_parsed("logback", {"pattern": "'logback'", **BASE})
_parsed("spring-boot", {"pattern": "'spring-boot'", **BASE, "service": "service", "trace_id": "'abcdef0123456789'", "span_id": "'0123456789abcdef'", "pid": "'77'"})
_parsed("spring-boot-sleuth", {"pattern": "'spring-boot-sleuth'", **BASE, "service": "service", "trace_id": "trace_id", "span_id": "trace_id"})
_parsed("bracketed", {"pattern": "'bracketed'", **BASE})
_parsed("level-first-thread", {"pattern": "'level-first-thread'", **BASE})
_parsed("ts-level", {"pattern": "'ts-level'", "level": "level", "message": "message"})


@query(f"WITH {SQL} SELECT seq, epoch_us(ts) // 1000 AS ts_ms, level, logger, thread, message, trace_id, session_id, service AS tenant, status, method FROM ev")
def parse_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = log_lines(spark, sf_dir, "json").withColumn("values", scalars(json_object(F.col("line")))).withColumn("said", context(F.col("values")))
    f = json_fields(F.col("values"), F.col("said"), "UTC", "2024-01-01")
    return d.select(
        "seq", F.floor(F.unix_micros(f["ts"]) / 1000).cast("long").alias("ts_ms"), *[f[n].alias(n) for n in ("level", "logger", "thread", "message", "trace_id", "session_id")],
        F.try_element_at(f["attributes"], F.lit("tenant")).alias("tenant"), f["http"]["status"].alias("status"), f["http"]["method"].alias("method"),
    )


@query(f"WITH {SQL} SELECT seq, user_id::VARCHAR AS user_id, ms AS duration_ms FROM ev")
def mine_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("message")
    return raw_events(spark, sf_dir).select("seq", last_id(pairs(m), "user_id").alias("user_id"), duration_ms(m).alias("duration_ms"))


@query(f"WITH {SQL} SELECT seq, 'OUTBOUND' AS direction, 'GET' AS method, 'https://' || service || '.test/' || user_id AS url, service || '.test' AS host, 200 + k % 300 AS status, ms AS duration_ms FROM ev")
def mine_http(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("call GET https://"), "service", F.lit(".test/"), F.col("user_id").cast("string"), F.lit(" status="), (F.lit(200) + F.col("k") % 300).cast("string"), F.lit(" took "), F.col("ms").cast("string"), F.lit(" ms"))
    d = raw_events(spark, sf_dir).select("seq", inline_http(text).alias("h"))
    return d.select("seq", *[F.col(f"h.{n}").alias(n) for n in ("direction", "method", "url", "host", "status", "duration_ms")])


@query(f"WITH {SQL} SELECT seq, epoch_us(date_trunc('second', ts)) AS ts_us FROM ev")
def parse_timestamp_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shapes by turns, each of which must give the same moment."""
    t = lambda f: F.date_format("ts", f)
    shapes = [
        t("yyyy-MM-dd'T'HH:mm:ss'Z'"), t("yyyy-MM-dd'T'HH:mm:ss.SSSxxx"), t("yyyy-MM-dd HH:mm:ss,SSS"), t("dd.MM.yyyy HH:mm:ss.SSS"), t("yyyy/MM/dd HH:mm:ss"),
        F.unix_millis("ts").cast("string"), F.unix_seconds("ts").cast("string"), t("dd/MMM/yyyy:HH:mm:ss xx"),
    ]
    pick = F.get(F.array(*shapes), (F.col("seq") % len(shapes)).cast("int"))
    return raw_events(spark, sf_dir).select("seq", F.unix_micros(F.date_trunc("second", parse_timestamp(pick, "UTC", "2024-01-01"))).alias("ts_us"))




@query(r"""WITH l AS (SELECT doc_id, unnest(generate_series(1, len(p)))::INT AS line_no, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL)),
m AS (SELECT *, max(line_no) OVER (PARTITION BY doc_id) AS n, CASE WHEN line_no % 3 = 1 THEN '2024-01-01 10:00:00 INFO ' || line ELSE line END AS made FROM l)
SELECT doc_id, count(*) FILTER (line_no % 3 = 1) AS records, count(*) AS lines, max(len) AS longest FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, (line_no - 1) // 3) AS len FROM m) GROUP BY doc_id""")
def record_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents, every third with a time stamp, put together to records."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL")
    lines = d.select(F.col("doc_id"), F.col("doc_id").cast("string").alias("source_file"), F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line_no", F.col("pos") + 1)
    made = F.when(F.col("line_no") % 3 == 1, F.concat(F.lit("2024-01-01 10:00:00 INFO "), "line")).otherwise(F.col("line"))
    r = record_starts(classify(lines.withColumn("line", made), Parse())).groupBy("doc_id", "record_id").agg(F.count("*").alias("len"), F.max(F.col("start").cast("int")).alias("begun"))
    return r.groupBy("doc_id").agg(F.sum("begun").alias("records"), F.sum("len").alias("lines"), F.max("len").alias("longest"))


@query(f"WITH {SQL} SELECT seq, regexp_replace(message, '[0-9]+([.,][0-9]+)?', '<n>', 'g') || ' at <ts> of <uuid> <hex>' AS normal FROM ev")
def fingerprint_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    uuid = F.regexp_replace(F.md5(F.col("seq").cast("string")), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    text = F.concat("message", F.lit(" at "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" of "), uuid, F.lit(" "), F.substring(F.md5(F.col("message")), 1, 12))
    return raw_events(spark, sf_dir).select("seq", normalize(text).alias("normal"))


@query(f"WITH {SQL} SELECT seq, level AS parsed, CASE WHEN ms < 1000 THEN ms || ' ms' ELSE ((ms + 50) // 1000) || '.' || ((ms + 50) // 100 % 10) || ' s' END AS took, 'o.e.' || event_type AS short, CASE WHEN length(message) > 24 THEN message[1:21] || '...' ELSE message END AS brief FROM ev")
def scalar_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    spelled = F.element_at(F.create_map(*[F.lit(x) for p in {"ERROR": "severe", "WARN": " Warning ", "DEBUG": "finer", "INFO": "notice"}.items() for x in p]), F.col("level"))
    name = F.concat(F.lit("org.example_with_a_long_name."), "event_type")
    return raw_events(spark, sf_dir).select("seq", parse_level(spelled).alias("parsed"), format_duration(F.col("ms")).alias("took"), short_logger(name).alias("short"), shortened(F.col("message"), 24).alias("brief"))


def _correlated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate(log_events(spark, sf_dir), SETTINGS.correlation)


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_entries(_correlated(spark, sf_dir), SETTINGS.timeline)


def _ruled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list]:
    rules = parse_rules(RULES)
    return apply_rules(_entries(spark, sf_dir), rules), rules


@query(f"WITH {CORR} SELECT seq, corr_kind, corr_key FROM co")
def correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _correlated(spark, sf_dir).select("seq", "corr_kind", "corr_key")


@query(f"WITH {CORR} SELECT seq, corr_kind, corr_key FROM co")
def correlation_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by days of a thread, so that no task holds a thread."""
    return correlate(log_events(spark, sf_dir), replace(SETTINGS.correlation, block_seconds=86_400)).select("seq", "corr_kind", "corr_key")


@query(f"WITH {SQL}, g AS (SELECT *, count(*) OVER (PARTITION BY trace_id) AS n, bool_or(is_error) OVER (PARTITION BY trace_id) AS bad FROM ev WHERE trace_id IS NOT NULL) SELECT seq, trace_id AS corr_key FROM g WHERE n >= 3 OR bad")
def corr_min_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Correlation(priority=("TRACE",), inherit_trace_from_thread=False, fallback_to_file=False, min_events_per_timeline=3)
    return correlate(log_events(spark, sf_dir), own).select("seq", "corr_key")


@query(f"WITH {SQL} SELECT seq, CASE WHEN session_id IS NOT NULL THEN 'SESSION' ELSE 'FILE' END AS corr_kind, coalesce(session_id, 'events') AS corr_key FROM ev")
def corr_session_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Correlation(priority=("SESSION",), inherit_trace_from_thread=False)
    return correlate(log_events(spark, sf_dir), own).select("seq", "corr_kind", "corr_key")


@query(f"WITH {ENTRIES} SELECT corr_kind, corr_key, entry_no, seq, repeat_count, CASE WHEN repeat_count > 1 THEN last_us ELSE 0 END AS last_us FROM en")
def dedup_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).select("corr_kind", "corr_key", "entry_no", "seq", "repeat_count", F.coalesce(F.unix_micros("last_repeat_at"), F.lit(0)).alias("last_us"))


@query(f"WITH {ENTRIES} SELECT corr_kind, corr_key, entry_no, seq, repeat_count, since_start_ms, since_previous_ms FROM nt")
def entries_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats by days of a timeline, offsets by 100 entries of it."""
    own = replace(SETTINGS.timeline, block_seconds=86_400, block_entries=100)
    return build_entries(_correlated(spark, sf_dir), own).select("corr_kind", "corr_key", "entry_no", "seq", "repeat_count", "since_start_ms", "since_previous_ms")


@query(f"WITH {ENTRIES} SELECT corr_kind, corr_key, entry_no, since_start_ms, since_previous_ms FROM nt")
def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).select("corr_kind", "corr_key", "entry_no", "since_start_ms", "since_previous_ms")


@query(f"""WITH {ENTRIES}, a AS (SELECT *, CASE WHEN kind = 'HTTP_REQUEST' THEN min(CASE WHEN kind = 'HTTP_RESPONSE' THEN entry_no END) OVER (PARTITION BY corr_kind, corr_key ORDER BY entry_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) END AS answer FROM en),
b AS (SELECT corr_kind, corr_key, answer, string_agg('e' || entry_no, ',' ORDER BY entry_no) AS askers FROM a WHERE answer IS NOT NULL GROUP BY ALL)
SELECT a.corr_kind, a.corr_key, a.entry_no, CASE WHEN a.answer IS NOT NULL THEN 'e' || a.answer ELSE coalesce(b.askers, '') END AS related FROM a LEFT JOIN b ON a.corr_kind = b.corr_kind AND a.corr_key = b.corr_key AND a.entry_no = b.answer""")
def http_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).select("corr_kind", "corr_key", "entry_no", F.array_join("related_ids", ",").alias("related"))


NOTES_SQL = """concat_ws(',', CASE WHEN exc IS NOT NULL THEN 'EXCEPTION:' || split_part(exc, '.', 3) END, CASE WHEN exc IS NULL AND level = 'ERROR' THEN 'ERROR:error' END, CASE WHEN level = 'WARN' THEN 'WARNING:warning' END,
  CASE WHEN status >= 500 THEN 'HTTP_SERVER_ERROR:HTTP ' || status END, CASE WHEN ms >= 1000 THEN 'SLOW:took ' || ms || ' ms' END,
  CASE WHEN since_previous_ms >= 3600000 THEN 'SLOW:pause of ' || (since_previous_ms // 60000) || ' min ' || (since_previous_ms % 60000 // 1000) || ' s before' END, CASE WHEN repeat_count > 1 THEN 'RETRY:repeats: ' || repeat_count END)"""


@query(f"WITH {ENTRIES} SELECT corr_kind, corr_key, entry_no, {NOTES_SQL} AS notes FROM nt")
def annotate_builtin(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.array_join(F.transform("annotations", lambda a: F.concat(a["type"], F.lit(":"), a["label"])), ",")
    return _entries(spark, sf_dir).select("corr_kind", "corr_key", "entry_no", text.alias("notes"))


HITS = f"""{ENTRIES}, w AS (SELECT *, max(CASE WHEN level = 'WARN' THEN us END) OVER (PARTITION BY corr_kind, corr_key ORDER BY entry_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS warned FROM nt),
r AS (SELECT *, level = 'ERROR' AND coalesce(warned >= us - 7200000000, false) AS h0, coalesce(exc LIKE '%SocketTimeoutException%', false) AS h1, coalesce(status >= 500, false) AS h2, ms >= 3000 AND NOT coalesce(status >= 500, false) AS h3 FROM w),
hit AS (SELECT *, 0 AS rule_no, 'error-after-warning' AS rule FROM r WHERE h0 UNION ALL SELECT *, 1, 'timeout' FROM r WHERE h1 UNION ALL SELECT *, 2, 'server-error' FROM r WHERE h2 UNION ALL SELECT *, 3, 'slow' FROM r WHERE h3)"""


@query(f"WITH {HITS} SELECT corr_kind, corr_key, entry_no, rule_no, rule FROM hit")
def rules_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with look-back (error-after-warning) and an early stop (server-error ends before slow)."""
    ruled, rules = _ruled(spark, sf_dir)
    return rule_hits(ruled, rules).select("corr_kind", "corr_key", "entry_no", "rule_no", "rule")


CAUSES = f"""{HITS},
x AS (SELECT *, min(CASE WHEN is_error THEN entry_no END) OVER g AS fe, count(*) FILTER (is_error) OVER g AS errors, min(CASE WHEN exc IS NOT NULL THEN entry_no END) OVER g AS thrown,
  (h1 OR h0 OR h2 OR repeat_count > 1) AS marked FROM r WINDOW g AS (PARTITION BY corr_kind, corr_key)),
y AS (SELECT *, max(CASE WHEN marked AND entry_no BETWEEN fe - 10 AND fe - 1 THEN entry_no END) OVER (PARTITION BY corr_kind, corr_key) AS trig FROM x),
c AS (
  SELECT h.corr_kind, h.corr_key, h.entry_no, 0 AS src, h.rule_no, h.rule AS title, least(greatest(CASE h.rule_no WHEN 1 THEN 0.85::DOUBLE ELSE 0.7::DOUBLE END + CASE WHEN h.entry_no = y.fe THEN 0.07::DOUBLE ELSE 0.0::DOUBLE END - CASE WHEN h.is_error THEN 0.0::DOUBLE ELSE 0.15::DOUBLE END + CASE h.rule_no WHEN 0 THEN 0.0475::DOUBLE WHEN 1 THEN 0.0425::DOUBLE ELSE 0.0325::DOUBLE END, 0.0::DOUBLE), 1.0::DOUBLE) AS raw
  FROM hit h JOIN y USING (corr_kind, corr_key, entry_no) WHERE h.rule_no < 3 AND y.fe IS NOT NULL
  UNION ALL SELECT corr_kind, corr_key, entry_no, 1, 0, 'exception', 0.6::DOUBLE + 0.0::DOUBLE + 0.0::DOUBLE + CASE WHEN entry_no = fe THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END FROM y WHERE exc IS NOT NULL AND entry_no = coalesce(thrown, fe)
  UNION ALL SELECT corr_kind, corr_key, entry_no, 2, 0, 'trigger', 0.55::DOUBLE + CASE WHEN h1 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN repeat_count > 1 OR h0 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN status >= 500 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END FROM y WHERE entry_no = trig
  UNION ALL SELECT corr_kind, corr_key, entry_no, 3, 0, 'cascade', 0.5::DOUBLE FROM y WHERE entry_no = fe AND errors > 1),
f AS (SELECT *, raw * (0.85::DOUBLE + 0.15::DOUBLE * CASE corr_kind WHEN 'TRACE' THEN 1.0::DOUBLE WHEN 'SESSION' THEN 0.8::DOUBLE ELSE 0.65::DOUBLE END) AS confidence FROM c),
rk AS (SELECT *, row_number() OVER (PARTITION BY corr_kind, corr_key ORDER BY raw DESC, src, entry_no, rule_no)::INT AS rank FROM f WHERE confidence >= 0.3)"""
KIND = {"Error after a warning": "error-after-warning", "Remote service too slow": "timeout", "Server error": "server-error"}


def _causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled, rules = _ruled(spark, sf_dir)
    return root_causes(ruled, rules, SETTINGS.analysis)


def _cause_name() -> Column:
    return F.coalesce("rule", F.when(F.col("category") == "exception", "exception").when(F.col("title").startswith("Cascade"), "cascade").when(F.col("title").isNotNull(), "trigger"))


@query(f"WITH {CAUSES} SELECT corr_kind, corr_key, rank, entry_no, title, round(confidence, 6) AS confidence FROM rk WHERE rank <= 4")
def root_cause_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _causes(spark, sf_dir)
    return d.select("corr_kind", "corr_key", "rank", "entry_no", _cause_name().alias("title"), F.round("confidence", 6).alias("confidence"))


SPANS = f"""{ENTRIES}, tl AS (SELECT corr_kind, corr_key, min(us) AS start_us, max(greatest(us, CASE WHEN repeat_count > 1 THEN last_us ELSE us END)) AS end_us, sum(repeat_count)::BIGINT AS event_count, count(*) AS entry_count,
  count(*) FILTER (is_error) AS error_count, count(*) FILTER (level = 'WARN') AS warning_count, min(seq) AS first_seq FROM nt GROUP BY ALL)"""


@query(f"WITH {SPANS}, sv AS (SELECT corr_kind, corr_key, string_agg(service, ',' ORDER BY f) AS services FROM (SELECT corr_kind, corr_key, service, min(entry_no) AS f FROM nt GROUP BY ALL) GROUP BY ALL) SELECT tl.* EXCLUDE (first_seq), (end_us - start_us) // 1000 AS duration_ms, error_count > 0 AS is_failed, services FROM tl JOIN sv USING (corr_kind, corr_key)")
def timeline_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = timelines(_entries(spark, sf_dir))
    return d.select("corr_kind", "corr_key", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "event_count", "entry_count", "error_count", "warning_count", "duration_ms", "is_failed", F.array_join("services", ",").alias("services"))


@query(f"WITH {SPANS} SELECT corr_kind, corr_key, error_count, (end_us - start_us) // 1000 AS duration_ms FROM tl WHERE error_count > 0 AND contains(corr_key, '1') ORDER BY error_count DESC, duration_ms DESC, start_us, first_seq, corr_kind, corr_key LIMIT 20")
def top_timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = filter_timelines(timelines(_entries(spark, sf_dir)), trace="1", only_failed=True, top=20)
    return d.select("corr_kind", "corr_key", "error_count", "duration_ms")


@query(f"WITH {CAUSES}, tl AS (SELECT corr_kind, corr_key, sum(repeat_count)::BIGINT AS event_count, count(*) FILTER (is_error) AS error_count FROM nt GROUP BY ALL) SELECT tl.*, title, round(confidence, 6) AS confidence FROM tl LEFT JOIN (SELECT * FROM rk WHERE rank = 1) USING (corr_kind, corr_key) WHERE error_count > 0")
def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed timelines with their probable cause."""
    ruled, rules = _ruled(spark, sf_dir)
    d = failed_timelines(ruled, rules, SETTINGS.analysis)
    return d.select("corr_kind", "corr_key", "event_count", "error_count", _cause_name().alias("title"), F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {SQL}, f AS (SELECT seq, user_id % 16 AS ord, CASE WHEN seq % 3 = 0 THEN epoch_us(ts) END AS own FROM ev)
SELECT seq, coalesce(last_value(own IGNORE NULLS) OVER (ORDER BY ord, seq), 0) AS ts_us, own IS NULL AND last_value(own IGNORE NULLS) OVER (ORDER BY ord, seq) IS NOT NULL AS inherited FROM f""")
def timestamp_inherit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the events without a time take the last one before them, across files; by blocks of 500 lines."""
    d = log_events(spark, sf_dir).withColumn("ts", F.when(F.col("seq") % 3 == 0, F.col("ts"))).withColumn("seq", (F.col("user_id").cast("long") % 16) * LINES + F.col("seq"))
    d = inherit_timestamps(d, block_lines=500)
    late = F.coalesce(F.try_element_at("attributes", F.lit("timestampInherited")) == "true", F.lit(False))
    return d.select((F.col("seq") % LINES).alias("seq"), F.coalesce(F.unix_micros("ts"), F.lit(0)).alias("ts_us"), late.alias("inherited"))


@query(f"WITH {SQL} SELECT seq, CASE WHEN exc IS NOT NULL OR coalesce(status, 0) >= 400 THEN 'ERROR' WHEN k % 5 = 0 THEN 'INFO' ELSE level END AS guessed FROM ev")
def level_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of records that carry none: by exception or failed call, else by the first level word, else INFO."""
    d = log_events(spark, sf_dir).withColumn("k", F.regexp_extract("message", "k=(\\d+)", 1).cast("int"))
    word = F.when(F.col("k") % 5 == 0, "INFORMED about WARNINGS").when(F.col("level") == "WARN", "a WARNING: and an ERROR").otherwise(F.concat(F.lit("state ["), "level", F.lit("] FATAL")))
    return d.select("seq", guess_level(F.col("exception"), F.col("http"), word).alias("guessed"))


@query(f"WITH {SQL} SELECT seq, service AS nested, service AS bare, session_id AS session, status::VARCHAR AS deep FROM ev")
def json_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested values of JSON lines under dotted keys, those of a context under bare ones too."""
    d = log_lines(spark, sf_dir, "json").withColumn("values", scalars(json_object(F.col("line")))).withColumn("said", context(F.col("values")))
    a = json_fields(F.col("values"), F.col("said"), "UTC", "2024-01-01")["attributes"]
    get = lambda key: F.try_element_at(a, F.lit(key))
    return d.select("seq", get("mdc.tenant").alias("nested"), get("tenant").alias("bare"), get("mdc.sessionId").alias("session"), get("http_.response.status").alias("deep"))


WORDED = """
rules:
- {name: slow-words, priority: 50, when: {messageRegex: 'took [1-9][0-9]{3} ms'}, annotate: [{type: SLOW}]}
- {name: of-logger, priority: 40, when: {loggerRegex: '^app[.](click|view)$', levelAtLeast: INFO}, annotate: [{type: LIFECYCLE}]}
"""


@query(f"WITH {ENTRIES} SELECT corr_kind, corr_key, entry_no, 'slow-words' AS rule FROM nt WHERE regexp_matches(message, 'took [1-9][0-9]{{3}} ms') UNION ALL SELECT corr_kind, corr_key, entry_no, 'of-logger' FROM nt WHERE message LIKE 'view %'")
def rules_by_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions on messages and loggers; clicks are DEBUG and fall below the level asked for."""
    rules = parse_rules(WORDED)
    return rule_hits(apply_rules(_entries(spark, sf_dir), rules), rules).select("corr_kind", "corr_key", "entry_no", "rule")


@query(ORACLES["record_boundaries"])
def record_boundaries_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with ranges of seven lines, as files of any length are put together."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL")
    lines = d.select(F.col("doc_id"), F.col("doc_id").cast("string").alias("source_file"), F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line_no", F.col("pos") + 1)
    made = F.when(F.col("line_no") % 3 == 1, F.concat(F.lit("2024-01-01 10:00:00 INFO "), "line")).otherwise(F.col("line"))
    r = record_starts(classify(lines.withColumn("line", made), Parse()), F.floor(F.col("line_no") / 7))
    r = r.groupBy("doc_id", "record_id").agg(F.max("pos").alias("len"), F.max(F.col("start").cast("int")).alias("begun"))
    return r.groupBy("doc_id").agg(F.sum("begun").alias("records"), F.sum("len").alias("lines"), F.max("len").alias("longest"))


@query(f"WITH {SQL} SELECT seq, 'com.acme.Outer' || event_type || 'Exception' AS type, 'k=' || k AS message, 2 AS links, 'com.acme.Inner' || (user_id % 7) || 'Error' AS root, user_id::INT AS line, 41 AS omitted FROM ev")
def stack_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace with a cause made from every event and read back."""
    lines = F.array(
        F.concat(F.lit("com.acme.Outer"), "event_type", F.lit("Exception: k="), F.col("k").cast("string")),
        F.concat(F.lit("\tat com.acme.Service.call(Service.java:"), F.col("user_id").cast("string"), F.lit(") ~[app.jar:1.0]")),
        F.concat(F.lit("Caused by: com.acme.Inner"), (F.col("user_id") % 7).cast("string"), F.lit("Error: inner")),
        F.lit("\tat com.acme.Store.read(Native Method)"),
        F.lit("\t... 41 more"),
    )
    c = F.col("c")
    d = raw_events(spark, sf_dir).select("seq", exception_chain(lines).alias("c"))
    return d.select("seq", F.get(c, 0)["type"].alias("type"), F.get(c, 0)["message"].alias("message"), F.size(c).alias("links"), F.element_at(c, -1)["type"].alias("root"), F.get(F.get(c, 0)["frames"], 0)["line"].alias("line"), F.element_at(c, -1)["omitted"].alias("omitted"))


@query(f"""WITH {SQL} SELECT seq, 'com.acme.Outer' || event_type || 'Exception' AS type, 'com.acme.Close' || (k % 3) || 'Exception>com.acme.DiskError<0' || CASE WHEN k % 2 = 0 THEN '>com.acme.AgainException<1' ELSE '' END AS tree,
  user_id::INT AS close_line, CASE WHEN k % 2 = 0 THEN 'again ' || k END AS again, 'k=' || k || CASE WHEN k % 2 = 0 THEN '' ELSE chr(10) || 'tail' END AS cause_message FROM ev""")
def suppressed_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace with suppressed exceptions, their frames and their causes, made from every event and read back."""
    even = F.col("k") % 2 == 0
    lines = F.array_compact(F.array(
        F.concat(F.lit("com.acme.Outer"), "event_type", F.lit("Exception")),
        F.lit("\tat com.acme.Service.call(Service.java:1)"),
        F.concat(F.lit("\tSuppressed: com.acme.Close"), (F.col("k") % 3).cast("string"), F.lit("Exception: closing")),
        F.concat(F.lit("\t\tat com.acme.Store.close(Store.java:"), F.col("user_id").cast("string"), F.lit(")")),
        F.concat(F.lit("\tCaused by: com.acme.DiskError: k="), F.col("k").cast("string")),
        F.when(~even, "tail"),
        F.when(even, F.concat(F.lit("\t\tSuppressed: com.acme.AgainException: again "), F.col("k").cast("string"))),
    ))
    d = raw_events(spark, sf_dir).select("seq", F.get(exception_chain(lines), 0).alias("e"))
    below = F.col("e.suppressed")
    tree = F.array_join(F.transform(below, lambda n: F.concat(n["type"], F.coalesce(F.concat(F.lit("<"), n["parent"].cast("string")), F.lit("")))), ">")
    return d.select("seq", "e.type", tree.alias("tree"), F.get(F.get(below, 0)["frames"], 0)["line"].alias("close_line"), F.get(below, 2)["message"].alias("again"), F.get(below, 1)["message"].alias("cause_message"))


@query(f"WITH {SQL} SELECT seq, 200 + k % 300 AS status, 'Reason ' || k AS status_text, service AS served, event_type || chr(10) || 'k=' || k AS body FROM ev")
def http_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = F.array(
        F.concat(F.lit("HTTP/1.1 "), (F.lit(200) + F.col("k") % 300).cast("string"), F.lit(" Reason "), F.col("k").cast("string")),
        F.lit("X-Served-By: nobody"), F.concat(F.lit("X-Served-By: "), "service"), F.lit(""), F.col("event_type"), F.concat(F.lit("k="), F.col("k").cast("string")),
    )
    d = raw_events(spark, sf_dir).select("seq", parse_dump(block).alias("h"))
    return d.select("seq", "h.status", "h.status_text", F.try_element_at("h.headers", F.lit("X-Served-By")).alias("served"), "h.body")


@query(f"WITH {SQL} SELECT seq, level, 'EXCEPTION' AS kind, message || chr(10) || 'detail ' || k AS message, 'com.acme.Late' || event_type || 'Exception' AS type, 'k ' || k AS said, user_id::INT AS line FROM ev")
def record_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of four lines, by files of one sixteenth of the users: a formatted line, a line of text and a stack trace."""
    more = F.array(
        F.concat(F.lit("detail "), F.col("k").cast("string")),
        F.concat(F.lit("com.acme.Late"), "event_type", F.lit("Exception: k "), F.col("k").cast("string")),
        F.concat(F.lit("\tat com.acme.Service.run(Service.java:"), F.col("user_id").cast("string"), F.lit(")")),
    )
    tails = raw_events(spark, sf_dir).select("seq", (F.col("user_id") % 16).cast("int").alias("file_ord"), more.alias("more"))
    d = log_lines(spark, sf_dir, "logback").join(tails, "seq")
    d = d.select("file_ord", F.col("file_ord").cast("string").alias("source_file"), "seq", F.posexplode(F.concat(F.array("line"), "more")).alias("pos", "line"))
    e = parse_lines(d.select("source_file", "file_ord", (F.col("seq") * 4 + F.col("pos")).alias("line_no"), "line"), Parse(default_date="2024-01-01"))
    link = F.get("exception", F.lit(0))
    return e.select(F.floor((F.col("seq") % LINES) / 4).cast("long").alias("seq"), "level", "kind", "message", link["type"].alias("type"), link["message"].alias("said"), F.get(link["frames"], 0)["line"].alias("line"))


@query(f"""WITH {SQL} SELECT seq, 'com.acme.' || event_type || CASE WHEN k % 2 = 0 THEN 'Exception' ELSE 'Error' END AS type, 'said ' || k AS said, CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS frames FROM ev""")
def json_exception(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exceptions of JSON lines: as a stack trace in one text, or as an object with class and message."""
    even, k = F.col("k") % 2 == 0, F.col("k").cast("string")
    trace = F.concat(F.lit("com.acme."), "event_type", F.lit("Exception: said "), k, F.lit("\n\tat com.acme.Service.run(Service.java:5)"))
    parts = F.struct(F.concat(F.lit("com.acme."), "event_type", F.lit("Error")).alias("class"), F.concat(F.lit("said "), k).alias("message"))
    line = F.to_json(F.struct("message", F.when(even, trace).alias("stack_trace"), F.when(~even, parts).alias("error")))
    d = raw_events(spark, sf_dir).select("seq", line.alias("line")).withColumn("values", scalars(json_object(F.col("line")))).withColumn("said", context(F.col("values")))
    link = F.get(json_fields(F.col("values"), F.col("said"), "UTC", "2024-01-01")["exception"], F.lit(0))
    return d.select("seq", link.alias("x")).select("seq", "x.type", F.col("x.message").alias("said"), F.size("x.frames").alias("frames"))


@query(f"WITH {SQL} SELECT seq, 'com.acme.' || event_type || '.run(Service.java:' || user_id || ')' AS own, 'org.springframework.Proxy.call(Proxy.java)' AS chosen, 'com.acme.' || event_type || '.run(Service.java:' || user_id || ')' AS short FROM ev")
def app_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place in the application's own code, by the packages known as foreign and by packages named."""
    lines = F.array(
        F.lit("com.acme.WrongException: x"), F.lit("\tat java.util.List.of(Native Method)"), F.lit("\tat org.springframework.Proxy.call(Proxy.java)"),
        F.concat(F.lit("\tat com.acme."), "event_type", F.lit(".run(Service.java:"), F.col("user_id").cast("string"), F.lit(")")), F.lit("\tat com.acme.Main.main(Main.java:1)"),
    )
    d = raw_events(spark, sf_dir).select("seq", F.get(exception_chain(lines), 0).alias("x"))
    place = lambda *packages: frame_text(app_frame(F.col("x"), packages))
    return d.select("seq", place().alias("own"), place("org.springframework.").alias("chosen"), place("com.acme.").alias("short"))
