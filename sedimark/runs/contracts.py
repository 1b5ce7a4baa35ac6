"""Document contracts: a small validator of JSON Schema's core, and the schemas of our documents."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

from sedimark.runs.documents import Items

_TYPES = {"object": dict, "array": (list, Items), "string": str, "boolean": bool, "null": type(None)}


class ContractError(ValueError):
    """A document breaks its contract."""


def _is(kind: str, value) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool)
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, _TYPES[kind])


def _equal(a, b) -> bool:
    return a == b and isinstance(a, bool) == isinstance(b, bool)


def problems(schema: dict, value, root: dict | None = None, at: str = "$") -> Iterator[str]:
    """What is wrong with a value, each with its place."""
    root = root if root is not None else schema
    if "$ref" in schema:
        target = root
        for step in schema["$ref"].removeprefix("#/").split("/"):
            target = target[step]
        yield from problems(target, value, root, at)
    if "type" in schema:
        kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        if not any(_is(k, value) for k in kinds):
            yield f"{at}: expected {' or '.join(kinds)}"
            return
    if "const" in schema and not _equal(schema["const"], value):
        yield f"{at}: expected {schema['const']!r}"
    if "enum" in schema and not any(_equal(x, value) for x in schema["enum"]):
        yield f"{at}: not one of the known values"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        yield from (f"{at}: {k} is missing" for k in schema.get("required", ()) if k not in value)
        more = schema.get("additionalProperties", True)
        for k, x in value.items():
            if k in known:
                yield from problems(known[k], x, root, f"{at}.{k}")
            elif more is False:
                yield f"{at}: {k} is unknown"
            elif isinstance(more, dict):
                yield from problems(more, x, root, f"{at}.{k}")
    if isinstance(value, (list, Items)):
        if len(value) < schema.get("minItems", 0):
            yield f"{at}: too few items"
        if schema.get("uniqueItems") and any(_equal(a, b) for i, a in enumerate(value) for b in value[:i]):
            yield f"{at}: repeated items"
        if "items" in schema:
            for i, x in enumerate(value):
                yield from problems(schema["items"], x, root, f"{at}[{i}]")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            yield f"{at}: too short"
        if "pattern" in schema and not re.search(schema["pattern"], value):
            yield f"{at}: not of the form {schema['pattern']}"
    if _is("number", value) and value < schema.get("minimum", value):
        yield f"{at}: below {schema['minimum']}"
    for part in schema.get("allOf", ()):
        yield from problems(part, value, root, at)
    if "anyOf" in schema and all(any(problems(x, value, root, at)) for x in schema["anyOf"]):
        yield f"{at}: fits none of the alternatives"
    if "oneOf" in schema and sum(not any(problems(x, value, root, at)) for x in schema["oneOf"]) != 1:
        yield f"{at}: must fit exactly one alternative"
    if "not" in schema and not any(problems(schema["not"], value, root, at)):
        yield f"{at}: fits what it must not"
    if "if" in schema:
        branch = "else" if any(problems(schema["if"], value, root, at)) else "then"
        yield from problems(schema.get(branch, {}), value, root, at)


def validate(contract: str, document) -> None:
    if found := list(itertools.islice(problems(SCHEMAS[contract], document), 5)):
        raise ContractError(f"{contract}: " + "; ".join(found))


def _closed(required: dict, optional: dict | None = None) -> dict:
    return {"type": "object", "required": list(required), "properties": required | (optional or {}), "additionalProperties": False}


_TEXT, _COUNT, _FLAG = {"type": "string"}, {"type": "integer", "minimum": 0}, {"type": "boolean"}
_DIGEST = _closed({"algorithm": {"const": "blake3-256"}, "value": {"type": "string", "pattern": "^[0-9a-f]{64}$"}})
_PATH = {
    "oneOf": [
        _closed({"encoding": {"const": "utf8"}, "value": _TEXT}),
        _closed({"encoding": {"const": "unix_bytes"}, "base64": {"type": "string", "pattern": "^[A-Za-z0-9+/]*=*$"}}),
    ]
}
_SUMMARY = _closed({k: _COUNT for k in ("file_count", "total_bytes", "media_files", "unsupported_files", "unreadable_files", "exact_duplicate_groups", "exact_duplicate_files", "reclaimable_bytes", "cache_hits")}, {k: _COUNT for k in ("unique_object_count", "hard_link_alias_path_count", "unstable_observation_count")})
_RUN = {"run_id": _TEXT, "created_at": _TEXT, "completed_at": _TEXT, "inputs": {"type": "array", "items": _TEXT, "minItems": 1}, "options": {"type": "object"}, "artifact_directory": _TEXT}

# The field names of the documents that commands publish and read.
SCHEMAS = {
    "run": _closed({"schema": {"const": "sedimark.run.v5"}, "artifact_set_id": _TEXT, **_RUN}),
    "report": {
        "type": "object",
        "required": ["schema", "generated_at", "run", "summary", "duplicate_groups", "observations"],
        "properties": {
            "schema": {"type": "string", "pattern": "^sedimark\\.report\\.v[1-5]$"},
            "summary": _SUMMARY,
            "duplicate_groups": {"type": "array", "items": {"type": "object", "required": ["group_id", "size_bytes", "content_hash", "member_count"], "properties": {"member_count": {"type": "integer", "minimum": 2}, "group_id": {"type": "string", "pattern": "^exact-[0-9a-f]{16}$"}}}},
            "observations": {"type": "array", "items": {"type": "object", "required": ["path", "size_bytes"], "properties": {"path": _PATH, "size_bytes": _COUNT}}},
        },
    },
    "plan": _closed({
        "schema": {"const": "sedimark.plan.v5"}, "plan_id": _TEXT, "source_run_id": _TEXT, "source_artifact_set_id": {"type": ["string", "null"]}, "created_at": _TEXT, "mode": {"const": "review_only"},
        "safety": _closed({"mutates_files": {"const": False}, "requires_explicit_apply": {"const": True}, "description": _TEXT}),
        "summary": _closed({"action_count": _COUNT, "candidate_file_count": _COUNT, "potential_reclaimable_bytes": _COUNT}),
        "actions": {"type": "array", "items": {"type": "object", "required": ["keep_path", "candidate_paths", "preconditions"]}},
    }),
    "artifact_set": _closed({
        "schema": {"const": "sedimark.artifact-set.v1"}, "set_id": _TEXT, "set_kind": {"enum": ["scan", "plan"]}, "run_id": _TEXT, "created_at": _TEXT, "state": {"const": "committed"}, "source_set_id": {"type": ["string", "null"]},
        "members": {"type": "array", "minItems": 1, "items": _closed({"kind": _TEXT, "schema": _TEXT, "path": _PATH, "size_bytes": _COUNT, "digest": _DIGEST})},
    }),
    "effective_policy": {"type": "object", "required": ["schema", "evidence_policy", "operational_policy", "presentation_policy", "safety_invariants", "fingerprints", "provenance"], "properties": {"schema": {"const": "sedimark.effective-policy.v1"}, "fingerprints": _closed({"effective_configuration": _DIGEST, "evidence_policy": _DIGEST})}},
    "config": _closed({"schema": {"const": "sedimark.config.v1"}}, {
        "output": _closed({}, {"format": {"enum": ["human", "json"]}}),
        "state": _closed({}, {"directory": {"type": "string", "minLength": 1}}),
        "scan": _closed({}, {k: _FLAG for k in ("follow_symlinks", "include_hidden", "cross_filesystems", "probe_media")}),
    }),
    "command_result": {"type": "object", "required": ["schema", "command", "outcome", "exit_code", "diagnostics"], "properties": {"exit_code": {"enum": [0, 1, 2, 3, 4, 5, 130, 143]}}, "if": {"properties": {"outcome": {"const": "success"}}}, "then": {"properties": {"exit_code": {"const": 0}}}, "else": {"properties": {"exit_code": {"not": {"const": 0}}}}},
}
