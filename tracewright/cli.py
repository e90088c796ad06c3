"""Command line: analyze, rules, patterns, prompt.  Exit codes: 0 done, 1 usage, 2 failure, 3 incidents found."""

from __future__ import annotations

import argparse
import os
import shutil
import sys
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import config as settings
from .operators.filters import parse_time, recognised
from .operators.text_patterns import text_fields
from .plans.analysis import analyze_files, analyze_text
from .reports.model import collect
from .reports.writers import WRITERS, to_prompt
from .rules.model import BUILTIN, in_order, load_rules
from .sources.files import MASKS, expand


def _listed(value: str) -> list[str]:
    """One option may name several things, parted by commas."""
    return [x for x in value.split(",") if x]


def _arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracewright")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("analyze", "prompt"):
        a = sub.add_parser(name)
        given = a.add_mutually_exclusive_group(required=True)
        given.add_argument("-i", "--input", action="append")
        given.add_argument("-t", "--text")
        given.add_argument("--stdin", action="store_true")
        given.add_argument("-p", "--paste", action="store_true")
        a.add_argument("--include", action="extend", type=_listed)
        a.add_argument("-r", "--recursive", action="store_true")
        a.add_argument("-o", "--output")
        a.add_argument("-f", "--format", choices=sorted(WRITERS), default="text")
        a.add_argument("-c", "--config")
        a.add_argument("--rules", action="extend", type=_listed, default=[])
        a.add_argument("--no-builtin-rules", action="store_true")
        for option in ("--trace", "--since", "--until", "--min-level", "--charset", "--zone"):
            a.add_argument(option)
        a.add_argument("--top", type=int, default=100)
        a.add_argument("--max-events", type=int)
        a.add_argument("--app-package", action="append", default=[])
        for option in ("--only-failed", "--no-stacktraces", "--fail-on-error"):
            a.add_argument(option, action="store_true")
    r = sub.add_parser("rules")
    r.add_argument("--rules", action="extend", type=_listed, default=[])
    r.add_argument("--no-builtin-rules", action="store_true")
    r.add_argument("--export")
    r.add_argument("--validate")
    q = sub.add_parser("patterns")
    q.add_argument("line")
    return p


def _session() -> SparkSession:
    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


def run(argv: list[str]) -> int:
    try:
        a = _arguments().parse_args(argv)
    except SystemExit as e:
        return 1 if e.code else 0
    try:
        if a.command == "rules":
            if a.export:
                os.makedirs(os.path.dirname(os.path.abspath(a.export)), exist_ok=True)
                shutil.copyfile(BUILTIN, a.export)
                print(f"built-in rules written to {os.path.abspath(a.export)}")
                return 0
            if a.validate:
                print(f"{a.validate} is valid, {len(load_rules((a.validate,), False))} rules")
                return 0
            for r in in_order(load_rules(tuple(a.rules), not a.no_builtin_rules)):
                print(f"{r.priority:>4} {r.name:<28} {r.description or ''}")
            return 0
        spark = _session()
        if a.command == "patterns":
            found = spark.range(1).select(text_fields(F.lit(a.line), settings.Parse()).alias("f")).first()["f"]
            print("no format matches" if found is None else "\n".join(f"{k}: {v}" for k, v in found.asDict().items() if v is not None))
            return 1 if found is None else 0
        c = settings.load(a.config)
        c = replace(
            c,
            parse=replace(c.parse, charset=a.charset or c.parse.charset, zone=a.zone or c.parse.zone, max_events=a.max_events or c.parse.max_events),
            rules=replace(c.rules, builtin=c.rules.builtin and not a.no_builtin_rules, files=c.rules.files + tuple(a.rules)),
            analysis=replace(c.analysis, application_packages=c.analysis.application_packages + tuple(a.app_package)),
        )
        filters = {"since": parse_time(a.since), "until": parse_time(a.until), "min_level": a.min_level and a.min_level.upper()}
        if a.input:
            paths = expand(a.input, tuple(a.include or MASKS), a.recursive, spark)
            found = analyze_files(spark, paths, c, **filters)
        else:
            if a.paste:
                print("Paste the log and end it with Ctrl+D (Ctrl+Z and Enter on Windows):", file=sys.stderr)
            text = a.text if a.text is not None else sys.stdin.read()
            if not text.strip():
                return 1
            paths, found = ["snippet"], analyze_text(spark, text, c, **filters)
        if not recognised(found.events):
            print("no line was recognised", file=sys.stderr)
        report = collect(found, paths, a.trace, a.only_failed, a.top)
        if a.command == "prompt":
            out = to_prompt(report, a.trace)
            if not out:
                return 1
        else:
            out = WRITERS[a.format](report, **({"stacks": False} if a.format == "text" and a.no_stacktraces else {}))
        if a.output:
            with open(a.output, "w", encoding="utf-8") as f:
                f.write(out)
        else:
            print(out, end="")
        return 3 if a.fail_on_error and any(t["is_failed"] for t in report["timelines"]) else 0
    except (ValueError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    except Exception as e:  # noqa: BLE001  the exit code tells callers
        print(f"failure: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
