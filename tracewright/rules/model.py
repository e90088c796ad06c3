"""Rules as read from YAML or JSON, strictly."""

from __future__ import annotations

import os
from dataclasses import dataclass
from typing import Any

from ..config import read_mapping
from ..schema import LEVELS

ANNOTATIONS = (
    "EXCEPTION ERROR WARNING RETRY EXTERNAL_CALL TIMEOUT SLOW DATABASE MESSAGING CACHE SECURITY CONFIGURATION RESOURCE RESILIENCE "
    "TRANSACTION VALIDATION HTTP_CLIENT_ERROR HTTP_SERVER_ERROR LIFECYCLE INFO"
).split()
BUILTIN = os.path.join(os.path.dirname(__file__), "builtin.yaml")
KINDS = ["LOG", "EXCEPTION", "HTTP_REQUEST", "HTTP_RESPONSE", "UNPARSED"]


@dataclass(frozen=True)
class Condition:
    """All set fields must hold; an empty condition never does."""

    messageRegex: str | None = None
    anyMessageRegex: tuple[str, ...] = ()
    exceptionType: str | None = None
    exceptionMessageRegex: str | None = None
    loggerRegex: str | None = None
    threadRegex: str | None = None
    level: str | None = None
    levelAtLeast: str | None = None
    kind: str | None = None
    httpStatus: tuple[int, ...] = ()
    httpStatusClass: str | None = None
    minDurationMs: int | None = None
    attributes: tuple[tuple[str, str], ...] = ()
    caseSensitive: bool = False

    def empty(self) -> bool:
        return self == Condition(caseSensitive=self.caseSensitive)


@dataclass(frozen=True)
class PrecededBy:
    when: Condition
    withinSeconds: int = 0


@dataclass(frozen=True)
class Cause:
    title: str | None = None
    description: str | None = None
    category: str | None = None
    confidence: float = 0.7
    recommendation: str | None = None


@dataclass(frozen=True)
class Rule:
    name: str
    when: Condition
    description: str | None = None
    enabled: bool = True
    priority: int = 0
    precededBy: PrecededBy | None = None
    annotate: tuple[tuple[str, str | None], ...] = ()
    cause: Cause | None = None
    stopOnMatch: bool = False


def _checked(kind: type, given: Any, where: str) -> dict:
    if not isinstance(given, dict):
        raise ValueError(f"{where}: a mapping is needed")
    for name in given:
        if name not in kind.__dataclass_fields__:
            raise ValueError(f"{where}: unknown property {name}")
    return dict(given)


def _condition(given: Any, where: str) -> Condition:
    c = _checked(Condition, given or {}, where)
    for name, allowed in (("level", LEVELS), ("levelAtLeast", LEVELS), ("kind", KINDS)):
        if c.get(name) is not None:
            c[name] = str(c[name]).upper()
            if c[name] not in allowed:
                raise ValueError(f"{where}.{name}: {c[name]} is none of {', '.join(allowed)}")
    for name in ("anyMessageRegex", "httpStatus"):
        c[name] = tuple(c.get(name) or ())
    c["attributes"] = tuple(sorted((c.get("attributes") or {}).items()))
    return Condition(**c)


def _rule(given: Any, at: str) -> Rule:
    r = _checked(Rule, given, at)
    name = str(r.get("name") or "").strip()
    if not name:
        raise ValueError(f"{at}: a rule needs a name")
    r["name"], r["when"] = name, _condition(r.get("when"), f"{name}.when")
    if r["when"].empty():
        raise ValueError(f"{name}: an empty condition never holds")
    if r.get("precededBy"):
        before = _checked(PrecededBy, r["precededBy"], f"{name}.precededBy")
        r["precededBy"] = PrecededBy(_condition(before.get("when"), f"{name}.precededBy.when"), int(before.get("withinSeconds") or 0))
    found = []
    for a in r.get("annotate") or ():
        kind = str(a.get("type")).upper()
        if kind not in ANNOTATIONS:
            raise ValueError(f"{name}.annotate: {kind} is no annotation")
        found.append((kind, a.get("label")))
    r["annotate"] = tuple(found)
    if r.get("cause"):
        r["cause"] = Cause(**_checked(Cause, r["cause"], f"{name}.cause"))
        if not 0 <= r["cause"].confidence <= 1:
            raise ValueError(f"{name}: confidence must lie between 0 and 1")
    return Rule(**r)


def parse_rules(text: str, origin: str = "rules") -> list[Rule]:
    """Rules of one source; their names must differ."""
    given = read_mapping(text)
    given = given.get("rules", []) if isinstance(given, dict) else given
    rules = [_rule(r, f"{origin}[{i}]") for i, r in enumerate(given)]
    names = [r.name for r in rules]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"{origin}: name used twice: {', '.join(twice)}")
    return rules


def builtin_rules() -> list[Rule]:
    with open(BUILTIN, encoding="utf-8") as f:
        return parse_rules(f.read(), "builtin")


def load_rules(files: tuple[str, ...] = (), builtin: bool = True) -> list[Rule]:
    rules = builtin_rules() if builtin else []
    for path in files:
        with open(path, encoding="utf-8") as f:
            rules += parse_rules(f.read(), path)
    return rules


def in_order(rules: list[Rule]) -> list[Rule]:
    """Enabled rules, the highest priority first, otherwise as given."""
    return sorted((r for r in rules if r.enabled), key=lambda r: -r.priority)
