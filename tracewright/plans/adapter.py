"""The events table as log events, and as log lines of the known formats; the same once more in SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.mining import http_struct
from ..schema import ATTRIBUTES, HTTP, LINK

COLUMNS = """
  event_id AS seq, event_type, user_id, CAST(ts AS TIMESTAMP) AS ts,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'click' THEN 'DEBUG' ELSE 'INFO' END AS level,
  concat('app.', event_type) AS logger,
  concat('http-', CAST(user_id % 16 AS STRING)) AS thread,
  CAST(floor(value * 10) AS BIGINT) AS ms,
  k,
  concat(event_type, ' took ', CAST(CAST(floor(value * 10) AS BIGINT) AS STRING), ' ms userId=', CAST(user_id AS STRING), ' k=', CAST(k AS STRING)) AS message,
  CASE WHEN event_id % 3 <> 0 THEN concat('t-', CAST(user_id AS STRING), '-', substr(CAST(ts AS STRING), 1, 10)) END AS trace_id,
  CASE WHEN event_id % 7 = 0 THEN concat('s-', CAST(user_id % 10 AS STRING)) END AS session_id,
  concat('svc-', CAST(user_id % 3 AS STRING)) AS service,
  CASE WHEN event_type = 'view' THEN 'GET' WHEN event_type = 'error' AND k % 4 = 0 THEN 'POST' END AS method,
  CASE WHEN event_type = 'view' AND k % 2 = 1 THEN 200 WHEN event_type = 'error' AND k % 4 = 0 THEN 503 END AS status,
  CASE WHEN event_type = 'error' AND k % 4 = 1 THEN 'java.net.SocketTimeoutException' WHEN event_type = 'error' AND k % 4 = 2 THEN 'java.lang.NullPointerException' END AS exc
"""

#: The same columns for DuckDB.
SQL = (
    "ev AS (SELECT *, CASE WHEN exc IS NOT NULL THEN 'EXCEPTION' WHEN status IS NOT NULL THEN 'HTTP_RESPONSE' WHEN method IS NOT NULL THEN 'HTTP_REQUEST' ELSE 'LOG' END AS kind, "
    "(level = 'ERROR' OR exc IS NOT NULL OR coalesce(status, 0) >= 500) AS is_error FROM (SELECT "
    + COLUMNS.replace("AS STRING", "AS VARCHAR")
    + " FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)))"
)


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return d.selectExpr(*_split(COLUMNS))


def _split(columns: str) -> list[str]:
    """Top-level commas part the columns."""
    out, depth, held = [], 0, ""
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(held)
            held = ""
        else:
            held += c
    return [x.strip() for x in [*out, held] if x.strip()]


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table in the shape of parsed events."""
    d = raw_events(spark, sf_dir)
    link = F.struct(F.col("exc").alias("type"), F.lit("failed").alias("message"), F.array().alias("frames"), F.lit(0).alias("omitted"), F.array().alias("suppressed"))
    http = http_struct(direction=F.lit("INBOUND"), method=F.col("method"), url=F.lit("/api/item"), status=F.col("status"))
    kind = F.when(F.col("exc").isNotNull(), "EXCEPTION").when(F.col("status").isNotNull(), "HTTP_RESPONSE").when(F.col("method").isNotNull(), "HTTP_REQUEST").otherwise("LOG")
    none = F.lit(None).cast("string")
    return d.select(
        *["seq", "ts", "level", "logger", "thread", "message", "trace_id"],
        none.alias("span_id"),
        "session_id",
        none.alias("request_id"),
        F.col("user_id").cast("string").alias("user_id"),
        "service",
        F.when(F.col("exc").isNotNull(), F.array(link)).cast(f"array<{LINK}>").alias("exception"),
        F.when(F.col("method").isNotNull(), http).cast(HTTP).alias("http"),
        kind.alias("kind"),
        F.create_map(F.lit("durationMs"), F.col("ms").cast("string")).cast(ATTRIBUTES).alias("attributes"),
        F.lit("events").alias("source_file"),
        F.col("seq").cast("int").alias("source_line"),
        F.col("message").alias("raw"),
    )


def log_lines(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    """seq and one line of the given format for every event."""
    d = raw_events(spark, sf_dir)
    t = lambda f: F.date_format("ts", f)
    iso, spaced = t("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), t("yyyy-MM-dd HH:mm:ss,SSS")
    trace = F.coalesce("trace_id", F.lit(""))
    lines = {
        "logback": F.concat(spaced, F.lit(" ["), "thread", F.lit("] "), "level", F.lit("  "), "logger", F.lit(" - "), "message"),
        "spring-boot": F.concat(iso, F.lit("  "), "level", F.lit(" 77 --- ["), "service", F.lit("] [  "), "thread", F.lit("] [abcdef0123456789,0123456789abcdef] "), "logger", F.lit("  : "), "message"),
        "spring-boot-sleuth": F.concat(t("yyyy-MM-dd HH:mm:ss.SSS"), F.lit("  "), "level", F.lit(" ["), "service", F.lit(","), trace, F.lit(","), trace, F.lit(",true] 77 --- ["), "thread", F.lit("] "), "logger", F.lit(" : "), "message"),
        "bracketed": F.concat(F.lit("["), spaced, F.lit("] ["), "level", F.lit("] ["), "thread", F.lit("] "), "logger", F.lit(": "), "message"),
        "level-first-thread": F.concat(spaced, F.lit(" "), "level", F.lit(" ["), "thread", F.lit("] "), "logger", F.lit(" - "), "message"),
        "ts-level": F.concat(t("dd.MM.yyyy HH:mm:ss.SSS"), F.lit(" "), "level", F.lit(" "), "message"),
        "json": F.to_json(
            F.struct(
                iso.alias("@timestamp"), F.lower("level").alias("level"), F.col("logger").alias("logger_name"), F.col("thread").alias("thread_name"), "message", F.col("trace_id").alias("traceId"),
                F.struct(F.col("session_id").alias("sessionId"), F.col("service").alias("tenant")).alias("mdc"), F.struct(F.struct("status").alias("response")).alias("http_"), F.col("status"), F.col("method"),
            )
        ),
    }
    return d.select("seq", lines[form].alias("line"))
