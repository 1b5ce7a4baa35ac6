"""Observations bound to one open file: read, and prove that what was read is what was discovered.

A file is opened once.  Its signature must equal the discovered one before the read, the open file's and
the path's must equal it after, or the attempt is void; a void attempt is made once more against a new
signature.  Evidence of two attempts is never mixed.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from sedimark.functions import blake3, media
from sedimark.functions.paths import to_bytes
from sedimark.operators.relate import size_frequency
from sedimark.operators.stability import classify
from sedimark.schemas import OBSERVATION, column_names, struct_type
from sedimark.sources import processes
from sedimark.sources.filesystem import ScanOptions, allocation, signature, stopped_by

_COLUMNS = column_names(OBSERVATION)
READ = 1 << 20
#: Files up to so many bytes are hashed side by side, where that is asked for; contents held at once.
SMALL, HELD = 1 << 18, blake3.SIDE_BY_SIDE
ATTEMPTS = 2
_MISSING_TOOL = "no ffprobe: the streams of this file stay undescribed"


class Unstable(Exception):
    def __init__(self, stability: str, validity: str, message: str):
        super().__init__(message)
        self.stability, self.validity = stability, validity


def _compare(expected: dict, found: dict, content_change: str, where: str) -> None:
    if found["is_symlink"] or found["filesystem_id"] is None or found["changed_unix_ns"] is None:
        raise Unstable("became_symlink" if found["is_symlink"] else "metadata_unavailable", "unavailable", f"no identity {where}")
    if (kind := classify(expected, found, content_change)) != "stable":
        raise Unstable(kind, "stale", f"the file changed {where}")


def _attempt(path: bytes, expected: dict, needs_hash: bool, cached: dict | None, options: ScanOptions, runner, hook: Callable[[str, bytes], None], cancelled: Callable[[], bool], digest: Callable) -> dict:
    try:
        before = os.lstat(path)
    except FileNotFoundError as error:
        raise Unstable("disappeared_during_scan", "unavailable", "the file is gone") from error
    except OSError as error:
        raise Unstable("unreadable", "unavailable", f"the file's state can't be read: {error.strerror}") from error
    _compare(expected, signature(before), "replaced_during_scan", "before it was opened")
    try:
        fd = os.open(path, os.O_RDONLY | os.O_NOFOLLOW | getattr(os, "O_CLOEXEC", 0))
    except OSError as error:
        raise Unstable("unreadable", "unavailable", f"the file can't be opened: {error.strerror}") from error
    try:
        hook("after_open", path)
        opened = os.fstat(fd)
        _compare(expected, signature(opened), "replaced_during_scan", "while it was opened")
        if cached is not None:
            row = {k: cached[k] for k in ("content_type", "media_kind", "status", "media", "content_hash")} | {"warnings": list(cached["warnings"] or [])}
        else:
            row = _analyse(fd, options, runner)
        if needs_hash:
            row["content_hash"] = digest(fd, cancelled)
        hook("after_evidence", path)
        _compare(expected, signature(os.fstat(fd)), "changed_during_hash" if needs_hash else "changed_during_probe", "while it was read")
        try:
            after = signature(os.lstat(path))
        except OSError as error:
            raise Unstable("disappeared_during_scan", "unavailable", "the path is gone") from error
        _compare(expected, after, "replaced_during_scan", "after it was read")
        return row | {"identity": expected, "allocation": allocation(opened)}
    except OSError as error:
        raise Unstable("unreadable", "unavailable", f"the file can't be read: {error}") from error
    finally:
        os.close(fd)


def _analyse(fd: int, options: ScanOptions, runner) -> dict:
    content_type = media.sniff(os.pread(fd, media.SNIFFED, 0))
    kind = media.kind_of(content_type)
    status = "unsupported" if kind in ("unknown", "other") else "analyzed"
    warnings, described = [], None
    if options.probe_media and runner is not None and kind in ("image", "video", "audio"):
        os.lseek(fd, 0, os.SEEK_SET)
        try:
            described = processes.probe(fd, runner)
        except processes.ToolError as error:
            warnings.append(f"media probe failed: {error}")
    elif options.probe_media and runner is None and status != "unsupported":
        warnings.append(_MISSING_TOOL)
    return {"content_type": content_type, "media_kind": kind, "status": status, "media": described, "content_hash": None, "warnings": warnings}


class Cancelled(Exception):
    """The command that wants the observation has been stopped."""


def _hash(fd: int, cancelled: Callable[[], bool]) -> str:
    os.lseek(fd, 0, os.SEEK_SET)
    digest = blake3.Hasher()
    while piece := os.read(fd, READ):
        if cancelled():
            raise Cancelled
        digest.update(piece)
    return digest.hexdigest()


def _small(fd: int, cancelled: Callable[[], bool]) -> bytes | str:
    """A small file's bytes, to be hashed with others; the hash of any other file."""
    if os.fstat(fd).st_size <= SMALL and len(content := os.pread(fd, SMALL + 1, 0)) <= SMALL:
        # a short read would leave a rest, which is asked for until there is none
        while more := os.pread(fd, SMALL + 1 - len(content), len(content)):
            content += more
            if len(content) > SMALL:
                return _hash(fd, cancelled)
        return content
    return _hash(fd, cancelled)


def _side_by_side(made: Iterator, column: str, cancelled: Callable[[], bool]) -> Iterator[list[dict]]:
    """Lists of rows in which contents under ``column`` have become hashes; about ``HELD`` bytes of them are held."""
    rows, size = [], 0

    def hashed() -> list[dict]:
        if cancelled():
            raise Cancelled
        raw = [r for r in rows if isinstance(r[column], bytes)]
        for r, digest in zip(raw, blake3.hash_many([r[column] for r in raw])):
            r[column] = digest
        return rows

    for row in made:
        rows.append(row)
        size += max(len(row[column]), blake3.CHUNK) if isinstance(row[column], bytes) else 0
        if size >= HELD or len(rows) >= 10_000:
            yield hashed()
            rows, size = [], 0
    if rows:
        yield hashed()


def observe_file(
    row: dict, options: ScanOptions, runner=None, hook: Callable[[str, bytes], None] = lambda stage, path: None, cancelled: Callable[[], bool] = lambda: False, digest: Callable = _hash
) -> dict:
    """The observation of one discovered file (columns of the discovered row, needs_hash, cached_...).

    ``cancelled`` is asked before each block that is hashed; if it holds, :class:`Cancelled` is raised.
    ``digest`` hashes an open file, or gives its bytes for the caller to hash.
    """
    path = to_bytes(row["path"])
    expected = {
        "is_symlink": False, "filesystem_id": str(row["device_id"]), "file_id": str(row["inode"]), "link_count": row["link_count"],
        "size_bytes": row["size_bytes"], "modified_unix_ns": row["modified_unix_ns"], "changed_unix_ns": row["changed_unix_ns"],
    }
    cached = {k.removeprefix("cached_"): v for k, v in row.items() if k.startswith("cached_")} if row.get("cache_hit") else None
    failed: Unstable | None = None
    for attempt in range(1, ATTEMPTS + 1):
        try:
            got = _attempt(path, expected, bool(row["needs_hash"]), cached, options, runner, hook, cancelled, digest)
        except Unstable as error:
            failed = error
            cached = None
            try:
                expected = signature(os.lstat(path))
            except OSError:
                break
            if expected["is_symlink"]:
                break
            continue
        own = got["identity"]
        return _observation(row) | {
            "content_type": got["content_type"], "media_kind": got["media_kind"], "status": got["status"], "media": got["media"], "warnings": got["warnings"],
            "content_hash": got["content_hash"], "hash_algorithm": "blake3" if got["content_hash"] is not None else None, "cache_hit": cached is not None,
            "size_bytes": own["size_bytes"], "modified_unix_ns": own["modified_unix_ns"], "changed_unix_ns": own["changed_unix_ns"],
            "filesystem_identity": {"platform": os.uname().sysname.lower(), "filesystem_id": own["filesystem_id"], "file_id": own["file_id"], "link_count": own["link_count"]},
            "storage_allocation": got["allocation"], "observation_stability": "stable", "evidence_validity": "current", "attempt_count": attempt,
        }
    return _observation(row) | {
        "status": "unreadable", "media_kind": "unknown", "warnings": [str(failed)], "observation_stability": failed.stability,
        "evidence_validity": failed.validity, "attempt_count": attempt,
    }


def hash_path(path: bytes, cancelled: Callable[[], bool] = lambda: False, hook: Callable[[str, bytes], None] = lambda stage, path: None, digest: Callable = _hash) -> tuple[str | None, str]:
    """(content hash, stability) of a path: a hash only if the file was the same before and after it was read."""
    try:
        expected = signature(os.lstat(path))
    except OSError as error:
        return None, instability(error)
    try:
        fd = os.open(path, os.O_RDONLY | os.O_NOFOLLOW)
    except OSError as error:
        return None, "became_symlink" if expected["is_symlink"] else instability(error)
    try:
        _compare(expected, signature(os.fstat(fd)), "replaced_during_scan", "before it was read")
        found = digest(fd, cancelled)
        hook("after_evidence", path)
        _compare(expected, signature(os.fstat(fd)), "changed_during_hash", "while it was read")
        _compare(expected, signature(os.lstat(path)), "replaced_during_scan", "after it was read")
    except Unstable as error:
        return None, error.stability
    except OSError as error:
        return None, instability(error)
    finally:
        os.close(fd)
    return found, "stable"


def hash_paths(raws: list[bytes], cancelled: Callable[[], bool] = lambda: False) -> Iterator[tuple[str | None, str]]:
    """:func:`hash_path` of many paths in order; each is proved as it is read, and small files are then hashed side by side."""
    made = (dict(zip(("digest", "kind"), hash_path(raw, cancelled, digest=_small))) for raw in raws)
    for rows in _side_by_side(made, "digest", cancelled):
        yield from ((r["digest"], r["kind"]) for r in rows)


def instability(error: OSError) -> str:
    return "disappeared_during_scan" if isinstance(error, FileNotFoundError) else "unreadable"


def has_content(path: bytes, size_bytes: int, content_hash: str) -> bool:
    """Whether a path, read whole and without change, still has a size and a hash."""
    digest, _ = hash_path(path)
    return digest == content_hash and os.lstat(path).st_size == size_bytes


def have_content(asked: list[tuple[bytes, int, str]]) -> Iterator[bool]:
    """:func:`has_content` of many (path, size, hash), each read whole again."""
    for (raw, size_bytes, content_hash), (digest, _) in zip(asked, hash_paths([a[0] for a in asked])):
        yield digest is not None and digest == content_hash and os.lstat(raw).st_size == size_bytes


def _observation(row: dict) -> dict:
    return dict.fromkeys(_COLUMNS) | {
        "observation_id": str(uuid.uuid4()), "path": row["path"], "path_key": row["path_key"], "components": row["components"], "size_bytes": row["size_bytes"],
        "modified_unix_ns": row["modified_unix_ns"], "changed_unix_ns": row["changed_unix_ns"], "device_id": row["device_id"], "inode": row["inode"], "cache_hit": False, "warnings": [],
    }


def with_needs(found: DataFrame) -> DataFrame:
    """``found`` with needs_hash: whether another discovered path has the same size.

    ``found`` must be a stored table: then both sides of the join have the same sizes, and no file is lost.
    """
    return found.join(size_frequency(found).select("size_bytes", (F.col("file_count") > 1).alias("needs_hash")), "size_bytes")


def observe(found: DataFrame, options: ScanOptions, run_id: str, stop: str | None = None) -> DataFrame:
    """Observations of discovered files (with needs_hash, and cached columns and cache_hit if looked up).

    A retried task observes its files anew, so the result must be stored before several queries read it.
    Tasks end early, with an error, once the file ``stop`` is there.
    """
    ddl = struct_type(OBSERVATION)
    schema = to_arrow_schema(ddl)

    def work(batches: Iterator[pa.RecordBatch]):
        import shutil

        runner, cancelled = processes.Runner() if options.probe_media and shutil.which("ffprobe") else None, stopped_by(stop)
        for batch in batches:
            if cancelled():
                raise Cancelled
            made = (observe_file(row, options, runner, cancelled=cancelled, digest=_small) | {"run_id": run_id} for row in batch.to_pylist())
            for rows in _side_by_side(made, "content_hash", cancelled):
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    # rows are small and work isn't: tasks are as many as keep all cores busy, not as the rows' bytes would make them
    return found.repartition(4 * found.sparkSession.sparkContext.defaultParallelism).mapInArrow(work, ddl)
