"""Layered policy: defaults, user file, project file, environment, command line; the last one wins.

Every override keeps what it replaced.  Two fingerprints name a policy: of all its values, and of what
bears on evidence alone; where values came from is in neither.
"""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import dataclass, field

from sedimark.functions import blake3
from sedimark.runs.contracts import SCHEMAS, problems
from sedimark.runs.outcome import Refused, blocking

CONFIG_SCHEMA, POLICY_SCHEMA = "sedimark.config.v1", "sedimark.effective-policy.v1"
PROJECT_FILE = "sedimark.toml"
SOURCES = ("default", "user_config", "project_config", "explicit_config", "environment", "command_line", "locked_invariant")

# Settings by canonical name, with (short name, environment variable, flags, kind).
SETTINGS = {
    "evidence_policy.follow_symlinks": ("scan.follow_symlinks", "SEDIMARK_FOLLOW_SYMLINKS", "--follow-symlinks / --no-follow-symlinks", bool),
    "evidence_policy.include_hidden": ("scan.include_hidden", "SEDIMARK_INCLUDE_HIDDEN", "--include-hidden / --exclude-hidden", bool),
    "evidence_policy.cross_filesystems": ("scan.cross_filesystems", "SEDIMARK_CROSS_FILESYSTEMS", "--cross-filesystems / --stay-on-filesystem", bool),
    "evidence_policy.probe_media": ("scan.probe_media", "SEDIMARK_PROBE_MEDIA", "--probe / --no-probe", bool),
    "operational_policy.state_directory": ("state.directory", "SEDIMARK_STATE_DIRECTORY", "--state-directory", str),
    "presentation_policy.output_format": ("output.format", "SEDIMARK_OUTPUT_FORMAT", "--output-format / --json", str),
}
# What no source can change.
LOCKED = {
    "evidence_policy.exact_grouping_profile": "blake3_complete_content",
    "evidence_policy.observation_stability": "required",
    "evidence_policy.unstable_observations": "exclude",
    "evidence_policy.maximum_observation_attempts": 2,
    "safety_invariants.source_mutation": False,
    "safety_invariants.apply_enabled": False,
    "safety_invariants.shell_execution": False,
    "safety_invariants.artifact_validation_required": True,
    "safety_invariants.atomic_artifact_commit_required": True,
    "safety_invariants.current_stability_required_for_exact_groups": True,
}
#: Invariants that decide what evidence means, and so belong to its fingerprint.
EVIDENCE_INVARIANTS = ("source_mutation", "apply_enabled", "shell_execution", "current_stability_required_for_exact_groups")
_BY_SHORT = {short: name for name, (short, *_) in SETTINGS.items()}


def canonical(name: str) -> str:
    found = _BY_SHORT.get(name, name)
    if found not in SETTINGS and found not in LOCKED:
        raise Refused(blocking("configuration_setting_unknown", "input", f"there is no setting {name}", setting=name))
    return found


@dataclass
class Resolution:
    values: dict[str, object]
    provenance: dict[str, dict]
    shadowed: list[dict] = field(default_factory=list)
    sources: list[dict] = field(default_factory=list)

    def apply(self, name: str, value, source: str, detail: str | None = None) -> None:
        if name in self.values:
            self.shadowed.append({"setting": name, "value": self.values[name], **self.provenance[name], "replaced_by": source})
        self.values[name] = value
        self.provenance[name] = {"source": source} | ({"detail": detail} if detail else {})

    @property
    def policy(self) -> dict:
        parts: dict[str, dict] = {"evidence_policy": {}, "operational_policy": {}, "presentation_policy": {}, "safety_invariants": {}}
        for name in (*SETTINGS, *LOCKED):
            section, _, key = name.partition(".")
            parts[section][key] = self.values[name]
        return {"schema": POLICY_SCHEMA, **parts, "fingerprints": fingerprints(parts), "provenance": dict(sorted(self.provenance.items()))}

    def explain(self, requested: str) -> dict:
        name = canonical(requested)
        short, variable, flags, kind = SETTINGS.get(name, (None, None, None, None))
        return {
            "setting": name, "value": self.values[name], **self.provenance[name], "locked": name in LOCKED, "short_name": short, "environment_variable": variable, "flags": flags,
            "accepts": "not configurable" if kind is None else "true or false" if kind is bool else "human or json" if "format" in name else "a path", "affects_evidence": name.startswith(("evidence_policy.", "safety_invariants.")),
            "shadowed": [s for s in self.shadowed if s["setting"] == name],
        }


def _digest(value) -> dict:
    return {"algorithm": "blake3-256", "value": blake3.hash_one(json.dumps(value, separators=(",", ":"), ensure_ascii=False).encode())}


def fingerprints(parts: dict) -> dict:
    whole = {k: parts[k] for k in ("evidence_policy", "operational_policy", "presentation_policy", "safety_invariants")}
    evidence = {"evidence_policy": parts["evidence_policy"], "safety_invariants": {k: parts["safety_invariants"][k] for k in EVIDENCE_INVARIANTS}}
    return {"effective_configuration": _digest(whole), "evidence_policy": _digest(evidence)}


def verify_fingerprints(policy: dict) -> None:
    if fingerprints(policy) != policy["fingerprints"]:
        raise Refused(blocking("effective_policy_fingerprint_mismatch", "state", "the stored policy doesn't have its fingerprints"))


def nearest_project_file(folder: str) -> str | None:
    """The configuration file of the folder or its nearest ancestor that has one."""
    while True:
        candidate = os.path.join(folder, PROJECT_FILE)
        if os.path.lexists(candidate):
            return candidate
        above = os.path.dirname(folder)
        if above == folder:
            return None
        folder = above


def user_file(environment: dict[str, str]) -> str:
    base = environment.get("XDG_CONFIG_HOME") or os.path.join(environment.get("HOME", "/"), ".config")
    return os.path.join(base, "sedimark", "config.toml")


def default_state_directory(environment: dict[str, str]) -> str:
    base = environment.get("XDG_STATE_HOME") or os.path.join(environment.get("HOME", "/"), ".local", "state")
    return os.path.join(base, "sedimark")


def _stable_read(path: str, hook=lambda: None) -> str:
    """A plain file's text, the same before and after; a second attempt if it was replaced meanwhile."""
    for attempt in (1, 2):
        try:
            if os.path.islink(path):
                raise Refused(blocking("configuration_not_regular_file", "input", "a configuration file can't be a link", path=path))
            fd = os.open(path, os.O_RDONLY | os.O_NOFOLLOW)
        except FileNotFoundError:
            raise Refused(blocking("configuration_not_found", "input", "the configuration file isn't there", path=path)) from None
        except OSError as error:
            raise Refused(blocking("configuration_unreadable", "input", f"the configuration file can't be read: {error.strerror}", path=path)) from error
        with os.fdopen(fd, "rb") as f:
            before = os.fstat(fd)
            if not os.path.isfile(path):
                raise Refused(blocking("configuration_not_regular_file", "input", "the configuration isn't a plain file", path=path))
            raw = f.read()
            hook()
            after, named = os.fstat(fd), os.stat(path) if os.path.exists(path) else None
        same = named is not None and all(getattr(before, k) == getattr(x, k) for x in (after, named) for k in ("st_dev", "st_ino", "st_size", "st_mtime_ns", "st_ctime_ns"))
        if same:
            return raw.decode("utf-8", "strict")
        if attempt == 2:
            raise Refused(blocking("configuration_source_replaced_during_read", "input", "the configuration file changed while it was read", path=path))
    raise AssertionError


def load_document(path: str) -> dict:
    try:
        text = _stable_read(path)
    except UnicodeDecodeError as error:
        raise Refused(blocking("configuration_parse_failed", "input", "the configuration isn't UTF-8", path=path)) from error
    try:
        document = tomllib.loads(text)
    except tomllib.TOMLDecodeError as error:
        place = {k: getattr(error, a) for k, a in (("line", "lineno"), ("column", "colno")) if getattr(error, a, None)}
        raise Refused(blocking("configuration_parse_failed", "input", f"the configuration isn't TOML: {error}", path=path, **place)) from error
    if "schema" not in document:
        raise Refused(blocking("configuration_schema_missing", "input", "the configuration names no schema", path=path))
    if document["schema"] != CONFIG_SCHEMA:
        raise Refused(blocking("configuration_schema_unsupported", "input", f"the schema {document['schema']!r} isn't known", path=path))
    if found := list(problems(SCHEMAS["config"], document)):
        code = "configuration_unknown_key" if any("is unknown" in p for p in found) else "configuration_value_invalid"
        raise Refused(blocking(code, "input", found[0], path=path))
    return document


def _boolean(name: str, text: str) -> bool:
    if text not in ("true", "false"):
        raise Refused(blocking("configuration_environment_invalid", "input", f"{name} must be true or false", environment_variable=name))
    return text == "true"


def resolve(command_line: dict[str, object] | None = None, config: str | None = None, no_config: bool = False, environment: dict[str, str] | None = None, folder: str | None = None) -> Resolution:
    """The effective policy; ``command_line`` has canonical names, with None for what wasn't given."""
    environment = dict(os.environ) if environment is None else environment
    folder = os.path.abspath(folder or os.getcwd())
    if config and no_config:
        raise Refused(blocking("configuration_selector_conflict", "input", "a configuration file and no configuration were both asked for"))
    out = Resolution({}, {})
    for name in SETTINGS:
        default = default_state_directory(environment) if name.endswith("state_directory") else "human" if name.endswith("output_format") else name.endswith("probe_media")
        out.apply(name, default, "default")
    for name, value in LOCKED.items():
        out.apply(name, value, "locked_invariant")

    def file(path: str, source: str) -> None:
        document = load_document(path)
        for name, (short, *_) in SETTINGS.items():
            section, key = short.split(".")
            if key in document.get(section, {}):
                value = document[section][key]
                out.apply(name, os.path.join(os.path.dirname(os.path.abspath(path)), value) if name.endswith("state_directory") else value, source, path)
        out.sources.append({"source": source, "status": "loaded", "path": path})

    if config:
        file(os.path.join(folder, config), "explicit_config")
    for source, path in (("user_config", user_file(environment)), ("project_config", nearest_project_file(folder))):
        if config or no_config:
            out.sources.append({"source": source, "status": "suppressed", "path": path})
        elif path and os.path.lexists(path):
            file(path, source)
        else:
            out.sources.append({"source": source, "status": "absent", "path": path})
    for name, (_, variable, _, kind) in SETTINGS.items():
        if variable in environment:
            text = environment[variable]
            if name.endswith("output_format") and text not in ("human", "json"):
                raise Refused(blocking("configuration_environment_invalid", "input", f"{variable} must be human or json", environment_variable=variable))
            if not text:
                raise Refused(blocking("configuration_environment_invalid", "input", f"{variable} is empty", environment_variable=variable))
            out.apply(name, _boolean(variable, text) if kind is bool else os.path.join(folder, text) if name.endswith("state_directory") else text, "environment", variable)
    for told, value in (command_line or {}).items():
        name = canonical(told)
        if value is not None:
            out.apply(name, os.path.join(folder, value) if name.endswith("state_directory") else value, "command_line")
    return out
