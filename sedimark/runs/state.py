"""Persistent state as tables in one folder: runs, observations, groups and the analysis cache.

Large tables are Parquet partitions by run, written before the run's status turns to completed, so a
reader never sees half a run.  A run's status is one small file, and its end another that only one process
can make.  The cache is a numbered table and a pointer to the current one.
"""

from __future__ import annotations

import json
import os
import shutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.operators import cache as cache_rows
from sedimark.runs import documents, publish
from sedimark.schemas import MEDIA

#: Each version of the layout, and the cache columns that it added.
MIGRATIONS = (
    (1, "path_key string, size_bytes bigint, modified_unix_ns bigint, content_type string, media_kind string, status string, content_hash string"),
    (2, "filesystem_id string, file_id string"),
    (3, f"evidence_validity string, warnings array<string>, media {MEDIA}"),
    (4, "probe_signature string"),
    (5, "changed_unix_ns bigint"),
)
VERSION = MIGRATIONS[-1][0]
CACHE = ", ".join(ddl for _, ddl in MIGRATIONS)


class StateError(Exception):
    """The state can't take the change."""


class StateStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, os.path.abspath(folder)

    def open(self, rebuild: Callable[[str, dict], dict[str, DataFrame]] | None = None) -> StateStore:
        """Create, bring to the current layout, and finish or clear what a crash left.

        ``rebuild`` makes a run's tables from its id and its published report.
        """
        for name in ("runs", "status", "tables", "cache"):
            os.makedirs(os.path.join(self.folder, name), exist_ok=True)
        self._migrate()
        self.recover(rebuild)
        return self

    def _at(self, *parts: str) -> str:
        return os.path.join(self.folder, *parts)

    def _replace(self, path: str, content: bytes) -> None:
        fresh = f"{path}.{publish.uuid7()}"
        publish.write_new(fresh, content)
        os.rename(fresh, path)
        publish.sync_folder(os.path.dirname(path))

    # --- layout

    def version(self) -> int:
        try:
            with open(self._at("version.json")) as f:
                return json.load(f)["version"]
        except FileNotFoundError:
            return 0

    def _migrate(self) -> None:
        """Forward only; each step once.  A step adds columns, which older tables show as null."""
        have = self.version()
        if have > VERSION:
            raise StateError(f"the state has version {have}; this program knows {VERSION}")
        for number, _ in MIGRATIONS[have:]:
            self._replace(self._at("version.json"), publish.json_bytes({"version": number}))

    # --- runs

    def begin(self, run_id: str, created_at: str) -> None:
        publish.write_new(self._at("status", run_id), publish.json_bytes({"run_id": run_id, "status": "running", "created_at": created_at}))

    def run(self, run_id: str) -> dict | None:
        for name in (f"{run_id}.end", run_id):
            try:
                with open(self._at("status", name)) as f:
                    return json.load(f)
            except (FileNotFoundError, ValueError):
                continue
        return None

    def status(self, run_id: str) -> str | None:
        return (self.run(run_id) or {}).get("status")

    def mark(self, run_id: str, status: str, **more) -> bool:
        """Turn a running run into another status; False if it no longer runs.

        The end is written aside and linked into place, which fails if another process was first.
        """
        row = self.run(run_id)
        if not row or row["status"] != "running":
            return False
        end = self._at("status", f"{run_id}.end")
        fresh = f"{end}.{publish.uuid7()}"
        publish.write_new(fresh, publish.json_bytes(row | {"status": status} | more))
        try:
            os.link(fresh, end)
        except FileExistsError:
            return False
        finally:
            os.unlink(fresh)
        publish.sync_folder(os.path.dirname(end))
        return True

    def runs(self) -> list[dict]:
        return [r for name in sorted(os.listdir(self._at("status"))) if "." not in name and (r := self.run(name))]

    def finalize(self, run_id: str, tables: dict[str, DataFrame], report_folder: str) -> None:
        """Store a run's tables, then complete it.  Done again it changes nothing."""
        status = self.status(run_id)
        if status == "completed":
            return
        if status != "running":
            raise StateError(f"run {run_id} is {status or 'unknown'}")
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(self._at("tables", name, f"run_id={run_id}"))
        self.mark(run_id, "completed", completed_at=publish.now(), report_folder=report_folder)

    def table(self, name: str, run_id: str | None = None) -> DataFrame:
        """A stored table, of completed runs alone."""
        wanted = [run_id] if run_id else [r["run_id"] for r in self.runs() if r["status"] == "completed"]
        paths = [p for r in wanted if os.path.isdir(p := self._at("tables", name, f"run_id={r}"))]
        if not paths:
            raise StateError(f"no completed run has {name}")
        return self.spark.read.option("basePath", self._at("tables", name)).option("mergeSchema", "true").parquet(*paths)

    def spool(self, name: str) -> str:
        """A new folder for what is written before it is published; whoever asked removes it."""
        path = self._at("spool", f"{name}-{publish.uuid7()}")
        os.makedirs(path)
        return path

    def run_folder(self, run_id: str) -> str:
        return self._at("runs", run_id)

    def recover(self, rebuild: Callable[[str, dict], dict[str, DataFrame]] | None = None) -> list[str]:
        """Remove half-written folders; finalize runs whose documents were published but not recorded; their ids.

        Manifest, run and report must name the same run and the same set.  Without ``rebuild`` such a run
        stays as it is, for a process that can store its tables.
        """
        publish.recover_staging(self._at("runs"))
        found = []
        for row in self.runs():
            folder = self.run_folder(row["run_id"])
            if row["status"] != "running" or not os.path.isdir(folder) or rebuild is None:
                continue
            inspected = publish.inspect_scan(folder)
            if inspected.status != "committed":
                continue
            run, report = (documents.load(os.path.join(folder, f"{name}.json")) for name in ("run", "report"))
            manifest = inspected.manifest
            if len({row["run_id"], manifest["run_id"], run["run_id"], report["run"]["run_id"]}) > 1 or len({manifest["set_id"], run["artifact_set_id"], report["artifact_set_id"]}) > 1:
                continue
            self.finalize(row["run_id"], rebuild(row["run_id"], report), folder)
            found.append(row["run_id"])
        return found

    # --- cache

    def _current(self) -> str | None:
        try:
            with open(self._at("cache", "CURRENT")) as f:
                return f.read().strip()
        except FileNotFoundError:
            return None

    def cache(self) -> DataFrame:
        """The analysis cache in the current columns; those an older table lacks are null."""
        current = self._current()
        return self.spark.read.schema(CACHE).parquet(self._at("cache", current)) if current else self.spark.createDataFrame([], CACHE)

    def remember(self, rows: DataFrame) -> None:
        """Put current analyses (one row a path) into the cache: a new table, then the pointer."""
        before = self._current()
        name = f"v-{publish.uuid7()}"
        cache_rows.upsert(self.cache(), rows.select(*self.cache().columns)).write.parquet(self._at("cache", name))
        self._replace(self._at("cache", "CURRENT"), name.encode())
        if before:
            shutil.rmtree(self._at("cache", before), ignore_errors=True)

    def cache_status(self) -> dict:
        size = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(self.folder) for f in names)
        rows = self.cache().agg(F.count("*")).first()[0]
        return {"state_directory": self.folder, "cached_files": rows, "completed_runs": sum(r["status"] == "completed" for r in self.runs()), "state_bytes": size}
