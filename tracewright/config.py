"""Settings, read strictly from YAML or JSON: unknown names fail."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, is_dataclass
from datetime import date
from typing import Any


@dataclass(frozen=True)
class CustomPattern:
    name: str
    regex: str


@dataclass(frozen=True)
class Parse:
    charset: str = "UTF-8"
    zone: str = "UTC"
    default_date: str = ""  # of lines that carry a time alone; today if empty
    patterns: tuple[CustomPattern, ...] = ()
    builtin_patterns: bool = True
    extract_from_message: bool = True
    max_events: int = 0
    max_multiline_lines: int = 2000
    block_lines: int = 0  # lines of a file that are put together in one task; 0: all

    def day(self) -> str:
        return self.default_date or date.today().isoformat()


@dataclass(frozen=True)
class Correlation:
    priority: tuple[str, ...] = ("TRACE", "REQUEST", "SESSION", "THREAD")
    thread_gap_seconds: int = 30
    inherit_trace_from_thread: bool = True
    inherit_window_seconds: int = 10
    additional_keys: tuple[str, ...] = ()
    fallback_to_file: bool = True
    min_events_per_timeline: int = 0
    block_seconds: int = 0  # stretch of a thread's time that one task looks through; 0: all of it


@dataclass(frozen=True)
class Timeline:
    dedup: bool = True
    dedup_normalize: bool = True
    dedup_window_seconds: int = 300
    slow_ms: int = 1000
    link_http: bool = True
    suspicious_gap_seconds: int = 5
    block_seconds: int = 0  # stretch of a timeline that one task looks through; 0: all of it
    block_entries: int = 0  # entries of a timeline likewise


@dataclass(frozen=True)
class RuleSources:
    builtin: bool = True
    files: tuple[str, ...] = ()


@dataclass(frozen=True)
class Analysis:
    min_confidence: float = 0.3
    max_alternatives: int = 3
    application_packages: tuple[str, ...] = ()
    detect_cascade: bool = True
    block_entries: int = 0  # entries of a timeline that one task looks through; 0: all


@dataclass(frozen=True)
class Config:
    parse: Parse = field(default_factory=Parse)
    correlation: Correlation = field(default_factory=Correlation)
    timeline: Timeline = field(default_factory=Timeline)
    rules: RuleSources = field(default_factory=RuleSources)
    analysis: Analysis = field(default_factory=Analysis)


def read_mapping(text: str) -> Any:
    """YAML, or JSON where the text begins with a brace."""
    if text.lstrip().startswith("{"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text) or {}


def _snake(name: str) -> str:
    return "".join("_" + c.lower() if c.isupper() else c for c in name)


def build(kind: type, given: Any, where: str = "") -> Any:
    """An instance of a settings class; names may be written in camel case."""
    if given is None:
        return kind()
    if not isinstance(given, dict):
        raise ValueError(f"{where or kind.__name__}: a mapping is needed")
    known = {f.name: f for f in fields(kind)}
    values = {}
    for name, value in given.items():
        key = _snake(str(name))
        if key not in known:
            raise ValueError(f"unknown property {where + '.' if where else ''}{name}")
        default = known[key].default_factory() if callable(getattr(known[key], "default_factory", None)) else known[key].default  # type: ignore[misc]
        if is_dataclass(default):
            value = build(type(default), value, str(name))
        elif key == "patterns":
            value = tuple(CustomPattern(**p) for p in value or ())
        elif isinstance(default, tuple):
            value = tuple(str(v) for v in value or ())
            if key == "priority":
                value = tuple(v.upper() for v in value)
        elif isinstance(default, bool) and not isinstance(value, bool):
            raise ValueError(f"{name}: true or false is needed")
        elif isinstance(default, str):
            value = "" if value is None else str(value)
        values[key] = value
    return kind(**values)


def load(path: str | None) -> Config:
    if not path:
        return Config()
    with open(path, encoding="utf-8") as f:
        return build(Config, read_mapping(f.read()))
