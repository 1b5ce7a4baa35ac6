"""Artifact sets: related JSON documents that appear together or not at all.

A scan's documents are written and flushed in a hidden sibling folder, then a marker with their sizes
and digests, then one rename shows them.  A plan keeps its file name: its marker is written as pending,
the plan renamed into place, then the marker; recovery finishes or removes what a crash left.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from sedimark.functions import blake3
from sedimark.functions.paths import from_bytes, to_bytes
from sedimark.runs import documents
from sedimark.runs.contracts import ContractError, validate

MARKER = "artifact-set.json"
SET_SCHEMA = "sedimark.artifact-set.v1"
_STAGING = ".sedimark-staging-"
SCAN_KINDS, PLAN_KINDS = ("effective_policy", "report", "run"), ("plan",)


@dataclass(frozen=True)
class Payload:
    """A document as bytes, or as a file that is moved into the set."""

    kind: str
    schema: str
    file_name: str
    content: bytes = b""
    source: str | None = None

    @classmethod
    def of(cls, kind: str, schema: str, file_name: str, document) -> Payload:
        return cls(kind, schema, file_name, json_bytes(document))

    def put(self, path: str) -> None:
        """Make the document a new file."""
        if self.source is None:
            write_new(path, self.content)
        else:
            try:
                os.link(self.source, path)  # refuses a path that is there; its bytes were flushed when it was written
            except FileExistsError:
                raise
            except OSError:  # another file system, or one without links
                with open(self.source, "rb") as f, open(path, "xb") as g:
                    shutil.copyfileobj(f, g, 1 << 20)
                    g.flush()
                    os.fsync(g.fileno())
            os.unlink(self.source)

    def measured(self) -> tuple[int, str]:
        """(bytes, digest)."""
        return measured(self.source) if self.source else (len(self.content), blake3.hash_one(self.content))


@dataclass(frozen=True)
class Inspection:
    status: str  # committed, incomplete, incompatible
    manifest: dict | None = None
    detail: str | None = None


def json_bytes(document) -> bytes:
    return (json.dumps(document, indent=2, ensure_ascii=False) + "\n").encode()


def measured(path: str) -> tuple[int, str]:
    """(bytes, digest) of a file, read piece by piece."""
    digest, size = blake3.Hasher(), 0
    with open(path, "rb") as f:
        while piece := f.read(1 << 20):
            digest.update(piece)
            size += len(piece)
    return size, digest.hexdigest()


def now() -> str:
    return datetime.now(UTC).isoformat()


def uuid7() -> str:
    """A time-ordered identifier: 48 bits of milliseconds, version and variant, the rest random."""
    raw = bytearray(int(datetime.now(UTC).timestamp() * 1000).to_bytes(6, "big") + os.urandom(10))
    raw[6] = 0x70 | raw[6] & 0x0F
    raw[8] = 0x80 | raw[8] & 0x3F
    return str(uuid.UUID(bytes=bytes(raw)))


def sync_folder(path: str) -> None:
    fd = os.open(path, os.O_RDONLY)
    try:
        os.fsync(fd)
    finally:
        os.close(fd)


def write_new(path: str, content: bytes) -> None:
    with open(path, "xb") as f:
        f.write(content)
        f.flush()
        os.fsync(f.fileno())


def _single(name: str) -> bool:
    return name not in ("", ".", "..") and "/" not in name and "\0" not in name


def _kinds(found: list[str], expected: tuple[str, ...]) -> None:
    """Set equality without repeats."""
    if sorted(found) != sorted(expected):
        raise ContractError(f"expected {', '.join(expected)}; found {', '.join(found) or 'nothing'}")


def _manifest(kind: str, run_id: str, set_id: str, payloads: list[Payload], source: str | None = None) -> dict:
    members = []
    for p in sorted(payloads, key=lambda p: p.kind):
        size, digest = p.measured()
        members.append({"kind": p.kind, "schema": p.schema, "path": _named(p.file_name), "size_bytes": size, "digest": {"algorithm": "blake3-256", "value": digest}})
    out = {"schema": SET_SCHEMA, "set_id": set_id, "set_kind": kind, "run_id": run_id, "created_at": now(), "state": "committed", "source_set_id": source, "members": members}
    validate("artifact_set", out)
    return out


def _named(name: str) -> dict:
    return {k: v for k, v in from_bytes(os.fsencode(name)).items() if v is not None}


def commit_scan(folder: str, run_id: str, set_id: str, payloads: list[Payload], hook: Callable[[str], None] = lambda stage: None) -> dict:
    """Publish a scan's documents as ``folder``; refuses one that is there.  ``hook`` serves fault tests."""
    _kinds([p.kind for p in payloads], SCAN_KINDS)
    if not all(_single(p.file_name) for p in payloads) or os.path.lexists(folder):
        raise FileExistsError(f"{folder} is there already or a member has no plain name")
    above, name = os.path.split(os.path.abspath(folder))
    os.makedirs(above, exist_ok=True)
    staging = os.path.join(above, f".{name}{_STAGING}{set_id}")
    os.mkdir(staging)
    try:
        manifest = _manifest("scan", run_id, set_id, payloads)
        for p in payloads:
            p.put(os.path.join(staging, p.file_name))
            hook("member")
        write_new(os.path.join(staging, MARKER), json_bytes(manifest))
        sync_folder(staging)
        hook("staged")
    except Exception:
        shutil.rmtree(staging, ignore_errors=True)
        raise
    os.rename(staging, folder)
    hook("published")
    sync_folder(above)
    return manifest


def plan_marker(path: str) -> str:
    return f"{path}.{MARKER}"


def _pending_marker(path: str) -> str:
    above, name = os.path.split(path)
    return os.path.join(above, f".{name}.{MARKER}.pending")


def commit_plan(path: str, run_id: str, source_set_id: str | None, payload: Payload, hook: Callable[[str], None] = lambda stage: None) -> dict:
    recover_plan(path)
    if os.path.lexists(path) or os.path.lexists(plan_marker(path)):
        raise FileExistsError(f"{path} is there already")
    above, name = os.path.split(os.path.abspath(path))
    if not _single(name) or not os.path.isdir(above):
        raise FileNotFoundError(f"{above} isn't a folder for a plan")
    set_id = uuid7()
    staged = os.path.join(above, f".{name}{_STAGING}{set_id}")
    own = Payload(payload.kind, payload.schema, name, payload.content, payload.source)
    manifest = _manifest("plan", run_id, set_id, [own], source_set_id)
    try:
        own.put(staged)
        hook("member")
        write_new(_pending_marker(path), json_bytes(manifest))
        sync_folder(above)
        hook("staged")
        os.rename(staged, path)
        hook("published")
    except OSError:
        for left in (staged, _pending_marker(path)):
            if os.path.lexists(left) and not os.path.lexists(path):
                os.unlink(left)
        raise
    os.rename(_pending_marker(path), plan_marker(path))
    sync_folder(above)
    return manifest


def recover_plan(path: str) -> Inspection:
    """Finish a plan whose pending marker fits it; else remove the pending marker and staged files."""
    above, name = os.path.split(os.path.abspath(path))
    pending = _pending_marker(path)
    if os.path.lexists(pending):
        if not os.path.lexists(plan_marker(path)) and _inspect(pending, above, "plan").status == "committed":
            os.rename(pending, plan_marker(path))
        else:
            os.unlink(pending)
        sync_folder(above)
    if os.path.isdir(above):
        for entry in os.listdir(above):
            if entry.startswith(f".{name}{_STAGING}"):
                os.unlink(os.path.join(above, entry))
    return inspect_plan(path)


def recover_staging(runs: str) -> int:
    """Remove folders that crashed scans left half written; how many there were."""
    left = [e for e in os.listdir(runs) if e.startswith(".") and _STAGING in e] if os.path.isdir(runs) else []
    for entry in left:
        shutil.rmtree(os.path.join(runs, entry))
    return len(left)


def inspect_scan(folder: str) -> Inspection:
    return _inspect(os.path.join(folder, MARKER), folder, "scan")


def inspect_plan(path: str) -> Inspection:
    return _inspect(plan_marker(path), os.path.dirname(os.path.abspath(path)), "plan")


def _inspect(marker: str, folder: str, kind: str) -> Inspection:
    """committed if the marker is known and every member is there with its size, digest and binding."""
    try:
        with open(marker, "rb") as f:
            manifest = json.loads(f.read())
    except FileNotFoundError:
        return Inspection("incomplete", None, "there is no marker")
    except (OSError, ValueError) as error:
        return Inspection("incompatible", None, f"the marker can't be read: {error}")
    try:
        validate("artifact_set", manifest)
        if manifest["set_kind"] != kind:
            raise ContractError(f"the set isn't a {kind}")
        _kinds([m["kind"] for m in manifest["members"]], SCAN_KINDS if kind == "scan" else PLAN_KINDS)
        names = [os.fsdecode(to_bytes({"value": None, "base64": None} | m["path"])) for m in manifest["members"]]
        if len(set(names)) != len(names) or not all(map(_single, names)):
            raise ContractError("members don't have names of their own")
    except (ContractError, KeyError, TypeError) as error:
        return Inspection("incompatible", None, str(error))
    for member, name in zip(manifest["members"], names):
        try:
            if os.path.getsize(os.path.join(folder, name)) != member["size_bytes"] or measured(os.path.join(folder, name)) != (member["size_bytes"], member["digest"]["value"]):
                return Inspection("incomplete", manifest, f"{name} isn't what was committed")
        except OSError as error:
            return Inspection("incomplete", manifest, f"{name} can't be read: {error}")
        document = documents.members(os.path.join(folder, name), "schema", "artifact_set_id")
        if document.get("schema") != member["schema"]:
            return Inspection("incompatible", manifest, f"{name} has another schema than the marker says")
        bound = document.get("artifact_set_id", document.get("run", {}).get("artifact_set_id") if isinstance(document.get("run"), dict) else None)
        if kind == "scan" and bound is not None and bound != manifest["set_id"]:
            return Inspection("incompatible", manifest, f"{name} belongs to another set")
    return Inspection("committed", manifest)
