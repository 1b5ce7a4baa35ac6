"""Diagnostics, the command envelope, and the class and exit code that follow from them."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from sedimark.schemas import EXIT_CODES

ENVELOPE = "sedimark.command-result.v1"


@dataclass
class Diagnostic:
    code: str
    severity: str
    classification: str
    impact: str
    message: str
    context: dict = field(default_factory=dict)

    def as_dict(self) -> dict:
        out = {"code": self.code, "severity": self.severity, "classification": self.classification, "impact": self.impact, "message": self.message}
        return out | ({"context": self.context} if self.context else {})


def blocking(code: str, classification: str, message: str, **context) -> Diagnostic:
    return Diagnostic(code, "error", classification, "blocks_command", message, context)


class Refused(Exception):
    """A command that can't go on; carries the diagnostic."""

    def __init__(self, diagnostic: Diagnostic):
        super().__init__(diagnostic.message)
        self.diagnostic = diagnostic


def coalesced(diagnostics: list[Diagnostic]) -> list[dict]:
    """Sorted by their JSON; neighbours that differ only in count become one, counts added."""
    rows = sorted((d.as_dict() for d in diagnostics), key=lambda d: json.dumps(d, ensure_ascii=False))
    out: list[dict] = []

    def without(d: dict) -> dict:
        return d | {"context": {k: v for k, v in d.get("context", {}).items() if k != "count"}}

    for row in rows:
        if out and without(out[-1]) == without(row):
            total = sum(d.get("context", {}).get("count", 1) for d in (out[-1], row))
            out[-1] = out[-1] | {"context": out[-1].get("context", {}) | {"count": total}}
        else:
            out.append(row)
    return out


def outcome_of(diagnostics: list[dict], coverage: str | None, artifacts: list, result) -> str:
    """The first class whose condition holds, gravest first."""
    codes = {d["code"] for d in diagnostics}
    blocked = {d["classification"] for d in diagnostics if d["impact"] == "blocks_command"}
    for outcome, holds in (
        ("interrupted", "operation_interrupted" in codes),
        ("terminated", "operation_terminated" in codes),
        ("internal_failure", blocked & {"internal", "artifact"}),
        ("stale_state", "state" in blocked),
        ("capability_unavailable", "capability" in blocked),
        ("invalid_input", "input" in blocked),
    ):
        if holds:
            return outcome
    if coverage == "partial" or any(d["impact"] == "degrades_coverage" for d in diagnostics):
        return "partial_success" if artifacts or result is not None else "internal_failure"
    return "success"


@dataclass
class CommandResult:
    command: str
    outcome: str
    exit_code: int
    coverage: str | None
    artifacts: list[dict]
    diagnostics: list[dict]
    result: object

    @classmethod
    def resolve(cls, command: str, coverage: str | None = None, artifacts: list[dict] | None = None, diagnostics: list[Diagnostic] | None = None, result=None) -> CommandResult:
        shown = coalesced(diagnostics or [])
        outcome = outcome_of(shown, coverage, artifacts or [], result)
        out = cls(command, outcome, EXIT_CODES[outcome], coverage, artifacts or [], shown, result)
        if problem := out.contradiction():
            failure = blocking("internal_invariant_violated", "internal", problem)
            return cls(command, "internal_failure", 1, None, [], [failure.as_dict()], None)
        return out

    def contradiction(self) -> str | None:
        if self.exit_code != EXIT_CODES[self.outcome]:
            return "the exit code isn't that of the outcome"
        if self.outcome == "success" and self.coverage == "partial":
            return "a success can't be partial"
        if self.outcome == "partial_success" and not self.artifacts and self.result is None:
            return "a partial success needs a result"
        return None

    def as_dict(self) -> dict:
        return {"schema": ENVELOPE, "command": self.command, "outcome": self.outcome, "exit_code": self.exit_code, "coverage": self.coverage, "artifacts": self.artifacts, "diagnostics": self.diagnostics, "result": self.result}


def escaped(text: str) -> str:
    """For a terminal: control characters can't act."""
    return "".join(c if c.isprintable() else c.encode("unicode_escape").decode() for c in text)


def human(result: CommandResult) -> tuple[str, str]:
    """(standard output, standard error)."""
    label = result.outcome.replace("_", " ")
    lines = [f"{result.command}: {label}" + (f", coverage {result.coverage}" if result.coverage else "")]
    lines += [f"  {a['kind']}: {escaped(str(a['path']))}" for a in result.artifacts]
    summary = (result.result or {}).get("summary") if isinstance(result.result, dict) else None
    lines += [f"  {k}: {v}" for k, v in (summary or {}).items()]
    errors = [f"{d['severity']}: {escaped(d['message'])}" + (f" ({d['context']['count']} times)" if d.get("context", {}).get("count") else "") for d in result.diagnostics]
    return "\n".join(lines) + "\n", "".join(e + "\n" for e in errors)
