"""Filesystem scans: walk roots, prune by policy, one row for each file and one for each issue.

Roots are examined on the driver, which also splits large trees by their upper folders; the walks run as
tasks on executors that see the same file system.  One walk makes one inventory, a stored table of files
and issues, and everything later reads that table: a file that changes meanwhile keeps its row.  A walk never
changes what it visits and never follows a link unless told to.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sedimark.functions import paths
from sedimark.schemas import DISCOVERED, ISSUES
from sedimark.storage import cut

INVENTORY = f"file struct<{DISCOVERED}>, issue struct<{ISSUES}>"
#: Walks that a scan is split into, and folders that the driver lists to that end, at most.
WALKS, PLANNED = 256, 1_000


@dataclass(frozen=True)
class ScanOptions:
    follow_symlinks: bool = False
    include_hidden: bool = False
    cross_filesystems: bool = False
    probe_media: bool = True


@dataclass
class Discovery:
    files: DataFrame
    issues: DataFrame
    accepted: int
    root_issues: list[dict] = field(default_factory=list)


def absolute(path: str) -> str:
    """Joined to the working folder, not resolved."""
    return path if os.path.isabs(path) else os.path.join(os.getcwd(), path)


def signature(info: os.stat_result) -> dict:
    """What identifies a file and its state; a link has no identity, times before 1970 are unknown."""
    link = stat.S_ISLNK(info.st_mode)
    return {
        "is_symlink": link,
        "filesystem_id": None if link else str(info.st_dev),
        "file_id": None if link else str(info.st_ino),
        "link_count": None if link else info.st_nlink,
        "size_bytes": info.st_size,
        "modified_unix_ns": info.st_mtime_ns if info.st_mtime_ns >= 0 else None,
        "changed_unix_ns": info.st_ctime_ns,
    }


def bare_signature(info: os.stat_result) -> dict:
    """What a platform without file identities can tell: size and modification time."""
    return dict.fromkeys(("filesystem_id", "file_id", "link_count", "changed_unix_ns")) | {
        "is_symlink": stat.S_ISLNK(info.st_mode), "size_bytes": info.st_size, "modified_unix_ns": info.st_mtime_ns if info.st_mtime_ns >= 0 else None,
    }


def metadata_of_file(fd: int) -> dict:
    """Signature and allocation of an open file."""
    info = os.fstat(fd)
    return signature(info) | allocation(info)


def allocation_of_path(path: bytes, logical_size: int) -> dict:
    """Allocation and identity of a path; what can't be read is a warning and unknown figures, never an error."""
    try:
        info = os.lstat(path)
    except OSError as error:
        unknown = {"logical_size_bytes": logical_size, "allocated_size_bytes": None, "allocation_source": "unavailable", "extent_sharing_status": "unknown"}
        return {"allocation": unknown, "identity": None, "warnings": [f"no metadata of the path: {error.strerror}"]}
    own = signature(info)
    identity = None if own["is_symlink"] else {"platform": os.uname().sysname.lower(), **{k: own[k] for k in ("filesystem_id", "file_id", "link_count")}}
    return {"allocation": allocation(info) | {"logical_size_bytes": logical_size}, "identity": identity, "warnings": []}


def allocation(info: os.stat_result) -> dict:
    """Allocated bytes in units of 512, and where the figure comes from."""
    blocks = getattr(info, "st_blocks", None)
    return {
        "logical_size_bytes": info.st_size,
        "allocated_size_bytes": None if blocks is None else min(blocks * 512, (1 << 63) - 1),
        "allocation_source": "unavailable" if blocks is None else "st_blocks512",
        "extent_sharing_status": "unknown",
    }


def _issue(kind: str, path: bytes, message: str, error: OSError | None = None) -> dict:
    name = type(error).__name__.removesuffix("Error").lower() if error else None
    return {"kind": kind, "path": paths.display(paths.from_bytes(path)), "message": message, "os_error_kind": name}


def examine_root(root: bytes, options: ScanOptions) -> tuple[os.stat_result | None, dict | None]:
    """(the root's status, None) if it can be scanned, else (None, issue).  A link is never a root."""
    try:
        info = os.lstat(root)
    except OSError as error:
        return None, _issue("input_unavailable", root, f"the input can't be read: {error.strerror}", error)
    if stat.S_ISLNK(info.st_mode) and not options.follow_symlinks:
        return None, _issue("input_excluded_by_policy", root, "the input is a symbolic link, which the policy excludes")
    if not (stat.S_ISREG(info.st_mode) or stat.S_ISDIR(info.st_mode)):
        return None, _issue("invalid_input_type", root, "the input is neither a file nor a folder")
    return info, None


def file_row(path: bytes, info: os.stat_result) -> dict:
    native = paths.from_bytes(path)
    own = signature(info)
    return {
        "path": native, "path_key": paths.key_of(native), "components": paths.component_key(path), "size_bytes": own["size_bytes"], "modified_unix_ns": own["modified_unix_ns"],
        "changed_unix_ns": own["changed_unix_ns"], "device_id": info.st_dev, "inode": info.st_ino, "link_count": own["link_count"],
    }


@dataclass(frozen=True)
class Walk:
    """A root, or a folder below one: the folders above it (to notice loops), the root's device, whether to go deeper."""

    folder: bytes
    above: tuple
    device: int | None
    deep: bool = True


def _state_folder(state_directory: bytes | None) -> bytes | None:
    return os.path.realpath(state_directory) if state_directory and os.path.exists(state_directory) else state_directory


def _listed(at: Walk, options: ScanOptions, held_out: bytes | None) -> Iterator[tuple[str, object]]:
    """("file", row), ("issue", row) and ("folder", walk) of one folder's entries."""
    try:
        with os.scandir(at.folder) as listing:
            entries = sorted(listing, key=lambda e: e.name)
    except OSError as error:
        yield "issue", _issue("traversal_incomplete", at.folder, f"the folder can't be listed: {error.strerror}", error)
        return
    for entry in entries:
        path = os.path.join(at.folder, entry.name)
        if held_out and (path == held_out or path.startswith(held_out + b"/")):
            continue
        if not options.include_hidden and entry.name.startswith(b"."):
            continue
        try:
            is_folder = entry.is_dir(follow_symlinks=options.follow_symlinks)
            is_file = entry.is_file(follow_symlinks=options.follow_symlinks)
            if is_folder:
                info = os.stat(path)
                if not options.cross_filesystems and info.st_dev != at.device:
                    continue
                if (info.st_dev, info.st_ino) in at.above:
                    yield "issue", _issue("traversal_incomplete", path, "the folder contains itself through a link")
                    continue
                yield "folder", Walk(path, (*at.above, (info.st_dev, info.st_ino)), at.device)
            elif is_file:
                info = os.lstat(path)
                if stat.S_ISREG(info.st_mode):
                    yield "file", file_row(path, info)
                else:
                    yield "issue", _issue("path_changed", path, "the path is no longer a plain file")
        except OSError as error:
            yield "issue", _issue("traversal_incomplete", path, f"the entry can't be read: {error.strerror}", error)


def walk(root: bytes | Walk, options: ScanOptions, state_directory: bytes | None = None, cancelled=lambda: False) -> Iterator[tuple[str, dict]]:
    """("file", row) and ("issue", row) of one root, or of a part of one.

    The root itself is always visited.  Below it go, by policy: the state folder, hidden names, folders
    of another file system (files of one stay), and links.  ``cancelled`` is asked before each folder.
    """
    if not isinstance(root, Walk):
        info, issue = examine_root(root, options)
        if issue:
            yield "issue", issue
            return
        if stat.S_ISREG(info.st_mode):
            yield "file", file_row(root, info)
            return
        root = Walk(root, ((info.st_dev, info.st_ino),), info.st_dev)
    held_out = _state_folder(state_directory)
    pending = [root]
    while pending and not cancelled():
        below = []
        for kind, row in _listed(pending.pop(), options, held_out):
            if kind == "folder":
                below.append(row)
            else:
                yield kind, row
        if root.deep:
            pending += reversed(below)


def split_walks(roots: list[bytes], options: ScanOptions, state_directory: bytes | None = None, wanted: int = WALKS, planned: int = PLANNED) -> list[bytes | Walk]:
    """The roots cut into about ``wanted`` walks: upper folders alone, and what lies under them, breadth first."""
    held_out = _state_folder(state_directory)
    done: list[bytes | Walk] = []
    open_walks: list[Walk] = []
    for root in roots:
        info, issue = examine_root(root, options)
        if issue or stat.S_ISREG(info.st_mode):
            done.append(root)
        else:
            open_walks.append(Walk(root, ((info.st_dev, info.st_ino),), info.st_dev))
    while open_walks and planned > 0 and len(done) + len(open_walks) < wanted:
        at = open_walks.pop(0)
        planned -= 1
        done.append(replace(at, deep=False))
        open_walks += [row for kind, row in _listed(at, options, held_out) if kind == "folder"]
    return done + open_walks


class WalkPartition(InputPartition):
    def __init__(self, walk: bytes | Walk):
        self.walk = walk


class InventoryReader(DataSourceReader):
    def __init__(self, roots: list[bytes], options: ScanOptions, state_directory: bytes | None, stop: str | None, schema: StructType):
        self.roots, self.options, self.state_directory, self.stop, self.schema = roots, options, state_directory, stop, schema

    def partitions(self):
        return [WalkPartition(w) for w in split_walks(self.roots, self.options, self.state_directory)] or [WalkPartition(b"")]

    def read(self, partition: WalkPartition):
        if not partition.walk:
            return
        schema = to_arrow_schema(self.schema)
        rows = []
        for kind, row in walk(partition.walk, self.options, self.state_directory, stopped_by(self.stop)):
            rows.append({"file": None, "issue": None} | {kind: row})
            if len(rows) >= 10_000:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def stopped_by(path: str | None):
    """Whether a command has asked its tasks to stop, by a file that it made."""
    return (lambda: os.path.exists(path)) if path else (lambda: False)


class InventorySource(DataSource):
    """``spark.read.format("file_inventory")`` with the roots as hexadecimal, comma-separated, in ``roots``.

    A row has a file or an issue.  Walks end early once the file in option ``stop`` is there.
    """

    @classmethod
    def name(cls):
        return "file_inventory"

    def schema(self) -> str:
        return INVENTORY

    def reader(self, schema):
        told = {k: self.options.get(k, "false") == "true" for k in ("follow_symlinks", "include_hidden", "cross_filesystems")}
        roots = [bytes.fromhex(x) for x in self.options.get("roots", "").split(",") if x]
        state = self.options.get("state_directory")
        return InventoryReader(roots, ScanOptions(**told), bytes.fromhex(state) if state else None, self.options.get("stop"), schema)


def accept(roots: list[str | bytes], options: ScanOptions) -> tuple[list[bytes], list[dict]]:
    """(roots that can be scanned, issues of those that can't)."""
    accepted, refused = [], []
    for root in roots:
        raw = os.fsencode(absolute(os.fsdecode(root)))
        _, issue = examine_root(raw, options)
        if issue:
            refused.append(issue)
        elif raw not in accepted:
            accepted.append(raw)
    return accepted, refused


def inventory(spark: SparkSession, accepted: list[bytes], refused: list[dict], options: ScanOptions, state_directory: str | None = None, stop: str | None = None, keep=None) -> Discovery:
    """One walk over the accepted roots, kept as a table by ``keep`` (default: a scratch table).

    Every file is there once however often roots overlap, by the shortest of its spellings.
    """
    spark.dataSource.register(InventorySource)
    reader = spark.read.format("file_inventory").option("roots", ",".join(r.hex() for r in accepted))
    for k in ("follow_symlinks", "include_hidden", "cross_filesystems"):
        reader = reader.option(k, str(getattr(options, k)).lower())
    if state_directory:
        reader = reader.option("state_directory", os.fsencode(absolute(state_directory)).hex())
    if stop:
        reader = reader.option("stop", stop)
    rows = (keep or (lambda found: cut(found, "inventory")))(reader.load())
    plainest = F.min_by("file", F.struct(F.length("file.path_key"), "file.path_key")).alias("file")
    files = rows.where("file is not null").groupBy("file.components").agg(plainest).select("file.*")
    issues = rows.where("issue is not null").select("issue.*").distinct()
    if refused:
        issues = issues.unionByName(spark.createDataFrame(refused, ISSUES))
    return Discovery(files, issues, len(accepted), refused)


def discover(spark: SparkSession, roots: list[str | bytes], options: ScanOptions | None = None, state_directory: str | None = None, stop: str | None = None, keep=None) -> Discovery:
    """All files under the roots, and the issues met."""
    options = options or ScanOptions()
    return inventory(spark, *accept(roots, options), options, state_directory, stop, keep)
