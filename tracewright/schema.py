"""Shapes of the event table and of what is derived from it."""

from __future__ import annotations

FRAME = "struct<cls:string,method:string,file:string,line:int,native:boolean,raw:string>"
#: An exception below a suppressed one: parent is the place of its parent in the same array, null below the link itself;
#: relation is "suppressed" or "cause".
BELOW = f"struct<type:string,message:string,frames:array<{FRAME}>,omitted:int,parent:int,relation:string>"
#: One link of an exception chain, the outermost first; suppressed: the tree of its suppressed exceptions, parents first.
LINK = f"struct<type:string,message:string,frames:array<{FRAME}>,omitted:int,suppressed:array<{BELOW}>>"
HTTP = "struct<direction:string,method:string,url:string,host:string,status:int,status_text:string,duration_ms:bigint,headers:map<string,string>,body:string>"
ATTRIBUTES = "map<string,string>"

EVENT = (
    "seq long, ts timestamp, level string, logger string, thread string, message string, trace_id string, span_id string, "
    "session_id string, request_id string, user_id string, service string, "
    f"exception array<{LINK}>, http {HTTP}, kind string, attributes {ATTRIBUTES}, source_file string, source_line int, raw string"
)

#: seq = file ordinal * LINES + line, so the order of files and lines is one number.
LINES = 1 << 32

LEVELS = ["UNKNOWN", "TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL"]
RELIABILITY = {"TRACE": 1.0, "REQUEST": 0.95, "SESSION": 0.8, "THREAD": 0.65, "FILE": 0.4}
