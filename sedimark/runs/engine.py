"""The commands: doctor, scan, report, plan, cache status and configuration."""

from __future__ import annotations

import contextlib
import json
import os
import shutil
import signal
import threading
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from sedimark.functions import blake3
from sedimark.operators import account, cache, diagnostics, relate
from sedimark.plans import duplicates
from sedimark.runs import documents, publish
from sedimark.runs import policy as policies
from sedimark.runs.contracts import SCHEMAS, ContractError, problems, validate
from sedimark.runs.outcome import CommandResult, Diagnostic, Refused, blocking
from sedimark.runs.state import StateError, StateStore
from sedimark.schemas import OBSERVATION_DEFAULTS, SUMMARY_DEFAULTS, struct_type
from sedimark.sources import filesystem, observe
from sedimark.sources.processes import tool_status
from sedimark.storage import cut, joined_by_shuffles, release, shuffles_cleaned

REPORT, RUN, PLAN = "sedimark.report.v5", "sedimark.run.v5", "sedimark.plan.v5"
REPORT_VERSIONS = {f"sedimark.report.v{n}": n for n in range(1, 6)}


class Interrupted(Exception):
    """A signal asked the command to stop."""


class Signals:
    """A flag that SIGINT and SIGTERM set; a scan looks at it between its stages and stops its jobs.

    While a scan runs, ``stop`` is the path of a file whose presence ends its tasks' walks and hashes.
    """

    def __init__(self, spark: SparkSession | None = None):
        self.caught: int | None = None
        self.spark = spark
        self.stop: str | None = None

    def install(self) -> Signals:
        if threading.current_thread() is threading.main_thread():
            for number in (signal.SIGINT, signal.SIGTERM):
                signal.signal(number, self._catch)
        return self

    def _catch(self, number, _frame) -> None:
        self.caught = number
        if self.stop:
            with open(self.stop, "ab"):
                pass
        if self.spark is not None:
            self.spark.sparkContext.cancelAllJobs()

    def check(self) -> None:
        if self.caught is not None:
            raise Interrupted


def _interruption(signals: Signals, **context) -> Diagnostic:
    code = "operation_terminated" if signals.caught == signal.SIGTERM else "operation_interrupted"
    return blocking(code, "operation", "the command was stopped by a signal", **context)


def _plain(value):
    """Rows as JSON values: paths without empty members, decimals as numbers."""
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return {k: v for k, v in ((k, _plain(v)) for k, v in value.items()) if not (set(value) == {"encoding", "value", "base64"} and v is None)}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return int(value) if type(value).__name__ == "Decimal" else value


class Engine:
    def __init__(self, spark: SparkSession | None, resolution: policies.Resolution | None = None, signals: Signals | None = None):
        self.spark = spark  # ``config`` works without one
        self.resolution = resolution or policies.resolve()
        self.signals = signals or Signals(spark)

    @property
    def state_directory(self) -> str:
        return self.resolution.values["operational_policy.state_directory"]

    def _store(self) -> StateStore:
        store = StateStore(self.spark, self.state_directory)
        return store.open(lambda run_id, report: self._rebuilt(store, run_id, report))

    def _rebuilt(self, store: StateStore, run_id: str, report: dict) -> dict[str, DataFrame]:
        """The tables of a published run: from its stored observations, or from the report if those are gone."""
        where = store._at("tables", "observations", f"run_id={run_id}")
        if os.path.isdir(where):
            observed = self.spark.read.parquet(where)
            return self._tables(relate.facts(observed)) | {"observed": observed}
        return self._tables(self._facts(report["observations"], store._at("tables", "reported", f"run_id={run_id}")))

    def _facts(self, observations, folder: str) -> DataFrame:
        """Observations of a report as facts, stored block by block as they are read."""
        os.makedirs(folder, exist_ok=True)
        schema = to_arrow_schema(struct_type(_FACTS))
        block, number = [], 0

        def store() -> None:
            columns = zip(*block) if block else [[]] * len(schema)
            table = pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)
            pq.write_table(table, os.path.join(folder, f"part-{number:05}.parquet"))

        for o in observations:
            block.append(_fact(o))
            if len(block) == 20_000:
                store()
                block, number = [], number + 1
        store()
        return self.spark.read.schema(_FACTS).parquet(folder)

    def _guard(self, command: str, work) -> CommandResult:
        try:
            with contextlib.ExitStack() as held:
                if self.spark is not None:
                    held.enter_context(joined_by_shuffles(self.spark))
                    held.enter_context(shuffles_cleaned(self.spark))
                return work()
        except Refused as refused:
            return CommandResult.resolve(command, diagnostics=[refused.diagnostic])
        except (StateError, OSError) as error:
            return CommandResult.resolve(command, diagnostics=[blocking("state_transaction_failed", "internal", f"the state can't be used: {error}")])

    # --- scan

    def scan(self, inputs: list[str], hook=lambda stage: None) -> CommandResult:
        return self._guard("scan", lambda: self._scan(inputs, hook))

    def _scan(self, inputs, hook) -> CommandResult:
        options = filesystem.ScanOptions(**{k: self.resolution.values[f"evidence_policy.{k}"] for k in ("follow_symlinks", "include_hidden", "cross_filesystems", "probe_media")})
        accepted, refused = filesystem.accept(inputs, options)
        if self.signals.caught is not None:
            return CommandResult.resolve("scan", diagnostics=[_interruption(self.signals)])
        if not accepted:
            told = [blocking("invalid_command_input", "input", i["message"], path=i["path"]) for i in refused]
            return CommandResult.resolve("scan", diagnostics=told or [blocking("invalid_command_input", "input", "no input could be scanned")])
        store = self._store()
        run_id, set_id, created = publish.uuid7(), publish.uuid7(), publish.now()
        store.begin(run_id, created)
        folder = store.run_folder(run_id)
        self.signals.stop = store._at("status", f"{run_id}.stop")
        spool = store.spool(run_id)
        try:
            hook("begun")
            self.signals.check()

            def keep(rows: DataFrame) -> DataFrame:
                where = store._at("tables", "inventory", f"run_id={run_id}")
                rows.write.mode("overwrite").parquet(where)
                return self.spark.read.parquet(where)

            found = filesystem.inventory(self.spark, accepted, refused, options, self.state_directory, self.signals.stop, keep)
            hook("discovered")
            self.signals.check()
            tables = self._observe(store, found, options, run_id)
            hook("observed")
            self.signals.check()
            report, run = self._report(tables, inputs, options, run_id, set_id, created, folder, spool)
            validate("run", run)
            validate("report", report | {"observations": []})  # observations were checked where they became lines
            self.signals.check()
            policy = self.resolution.policy
            payloads = [
                publish.Payload.of("effective_policy", policy["schema"], "effective-policy.json", policy),
                publish.Payload.of("run", RUN, "run.json", run),
                publish.Payload("report", REPORT, "report.json", source=os.path.join(spool, "report.json")),
            ]
            publish.commit_scan(folder, run_id, set_id, payloads)
            for value in report.values():
                if isinstance(value, documents.Items):
                    value.path = os.path.join(folder, "report.json")
            hook("published")
        except Interrupted:
            store.mark(run_id, "interrupted", completed_at=publish.now())
            return CommandResult.resolve("scan", diagnostics=[_interruption(self.signals, run_id=run_id)])
        except Exception as error:
            if self.signals.caught is not None:
                store.mark(run_id, "interrupted", completed_at=publish.now())
                return CommandResult.resolve("scan", diagnostics=[_interruption(self.signals, run_id=run_id)])
            if publish.inspect_scan(folder).status != "committed":
                store.mark(run_id, "failed", completed_at=publish.now())
            code = "artifact_validation_failed" if isinstance(error, ContractError) or "ContractError" in str(error) else "artifact_commit_failed" if isinstance(error, OSError) else "internal_invariant_violated"
            return CommandResult.resolve("scan", diagnostics=[blocking(code, "internal" if code.startswith("internal") else "artifact", f"the scan failed: {error}", run_id=run_id)])
        finally:
            shutil.rmtree(spool, ignore_errors=True)
            if os.path.exists(self.signals.stop):
                os.unlink(self.signals.stop)
            self.signals.stop = None
        names = (("effective_policy", "effective-policy.json"), ("run", "run.json"), ("report", "report.json"), ("artifact_set", publish.MARKER))
        artifacts = [{"kind": k, "run_id": run_id, "path": os.path.join(folder, n)} for k, n in names]
        store.finalize(run_id, tables, folder)
        return self._scanned(store.table("diagnostics", run_id), options, report, artifacts)

    def _observe(self, store: StateStore, found: filesystem.Discovery, options, run_id: str) -> dict[str, DataFrame]:
        probe = tool_status("ffprobe", "media metadata")["version"] if options.probe_media else None
        files = found.files.withColumn("filesystem_id", F.col("device_id").cast("string")).withColumn("file_id", F.col("inode").cast("string"))
        looked = cache.lookup(observe.with_needs(files), store.cache().drop("evidence_validity"), probe)
        where = store._at("tables", "observations", f"run_id={run_id}")
        # stored before anything reads it: observing again could give other evidence
        observe.observe(looked, options, run_id, self.signals.stop).write.mode("overwrite").parquet(where)
        observed = self.spark.read.parquet(where)
        diagnostics.from_issues(found.issues, True).write.mode("overwrite").parquet(store._at("tables", "diagnostics", f"run_id={run_id}"))
        entries = observed.select(
            "path_key", "size_bytes", "modified_unix_ns", "content_type", "media_kind", "status", "content_hash", F.col("filesystem_identity.filesystem_id").alias("filesystem_id"),
            F.col("filesystem_identity.file_id").alias("file_id"), "evidence_validity", "warnings", "media", F.lit(probe).cast("string").alias("probe_signature"), "changed_unix_ns",
        )
        store.remember(entries)
        return self._tables(relate.facts(observed)) | {"observed": observed}

    def _tables(self, facts: DataFrame) -> dict[str, DataFrame]:
        digest = blake3.blake3_udf()
        return {"facts": facts, "duplicate_groups": relate.exact_groups(facts, digest), "plan_paths": duplicates.paths(facts, digest), "hard_link_groups": relate.hard_link_groups(facts)}

    def _report(self, tables, inputs, options, run_id, set_id, created, folder, spool) -> tuple[dict, dict]:
        """The report document, written to ``spool``.  Its lists come from tables line by line, so the driver
        holds none of them; members of a group are lines of their own."""
        facts, groups, links = (tables[k] for k in ("facts", "duplicate_groups", "hard_link_groups"))
        digest = blake3.blake3_udf()
        size, content, nothing = F.col("size_bytes"), F.col("content_hash"), F.lit("")
        members = relate.exact_members(facts, digest).select("group_id", "observation_id", "primary_path", "observed_path_count", "own_path", "size_bytes", "content_hash")
        links = links.select(relate.group_id("hl-", F.col("filesystem_id"), F.col("file_id"), digest).alias("group_id"), "*")
        lists = {
            "duplicate_groups": documents.lines(groups, size, content, 0, nothing, lambda g: _json(g)[:-1] + ', "members": [')
            .unionAll(documents.lines(members, size, content, 1, F.col("own_path"), lambda m: _json({k: m[k] for k in ("observation_id", "primary_path", "observed_path_count")})))
            .unionAll(documents.marks(groups, size, content, 2, "]}")),
            "hard_link_groups": documents.lines(links, F.lit(0), F.col("group_id"), 0, nothing, _json),
            "observations": documents.lines(tables["observed"].drop("components"), F.lit(0), F.col("path_key"), 0, nothing, _checked),
        }
        reclaim = _plain(account.run_reclaimability(groups).first())
        run = {"run_id": run_id, "created_at": created, "completed_at": publish.now(), "inputs": list(inputs), "options": vars(options), "artifact_directory": folder}
        head = {
            "schema": REPORT, "generated_at": publish.now(), "artifact_set_id": set_id, "run": run, "summary": _plain(account.scan_summary(facts).first()),
            "storage": _plain(account.storage_summary(facts).first()) | {"physical_reclaimability": reclaim},
        }
        report = documents.write(os.path.join(spool, "report.json"), head, lists, spool)
        return report, {"schema": RUN, "artifact_set_id": set_id, **run}

    def _scanned(self, issued, options, report, artifacts) -> CommandResult:
        issues = [Diagnostic(i.code, i.severity, i.classification, i.impact, i.message, {"path": i.path}) for i in issued.collect()]
        if options.probe_media and shutil.which("ffprobe") is None:
            issues.append(Diagnostic("optional_capability_unavailable", "warning", "capability", "none", "without ffprobe the streams of media files stay undescribed"))
        if unstable := report["summary"]["unstable_observation_count"]:
            issues.append(Diagnostic("result_produced_with_exclusions", "warning", "observation", "degrades_coverage", "observations that weren't stable were left out of exact conclusions", {"count": unstable}))
        partial = any(d.impact == "degrades_coverage" for d in issues)
        return CommandResult.resolve("scan", "partial" if partial else "complete", artifacts, issues, report)

    # --- stored reports

    def load_report(self, store: StateStore, reference: str) -> tuple[dict, str, dict | None]:
        """(report, its path, its set's manifest or None for older versions) by path, folder or run id."""
        if os.path.exists(reference):
            path = os.path.join(reference, "report.json") if os.path.isdir(reference) else reference
        else:
            try:
                uuid.UUID(reference)
            except ValueError:
                raise Refused(blocking("invalid_command_input", "input", "the reference is neither a report nor a run id")) from None
            row = store.run(reference)
            if not row or row["status"] != "completed":
                stopped = row is not None and row["status"] == "interrupted"
                raise Refused(blocking("source_run_interrupted" if stopped else "stored_run_not_found", "state", "the run was interrupted" if stopped else "no completed run has this id", run_id=reference))
            path = os.path.join(row["report_folder"], "report.json")
        report = decode_report(path)
        if report["schema"] != REPORT:
            return report, path, None
        found = publish.inspect_scan(os.path.dirname(os.path.abspath(path)))
        if found.status != "committed":
            raise Refused(blocking(f"artifact_set_{found.status}", "state", found.detail or "the artifact set isn't whole", path=path))
        if found.manifest["run_id"] != report["run"]["run_id"] or found.manifest["set_id"] != report.get("artifact_set_id"):
            raise Refused(blocking("artifact_set_incompatible", "state", "the report belongs to another set", path=path))
        return report, path, found.manifest

    def _source(self, report: dict, path: str) -> list[Diagnostic]:
        """What the stored scan's coverage and policy say about conclusions drawn from it now."""
        out = []
        summary = report["summary"]
        if summary["unstable_observation_count"] or summary["unreadable_files"]:
            out.append(Diagnostic("source_run_partial", "warning", "observation", "degrades_coverage", "the stored scan covers only a part of its inputs"))
        sidecar = os.path.join(os.path.dirname(path), "effective-policy.json")
        try:
            with open(sidecar) as f:
                stored = json.load(f)
            policies.verify_fingerprints(stored)
            if stored["fingerprints"]["evidence_policy"] != self.resolution.policy["fingerprints"]["evidence_policy"]:
                out.append(Diagnostic("source_policy_differs", "info", "input", "none", "the stored scan was made under another evidence policy"))
        except FileNotFoundError:
            out.append(Diagnostic("historical_policy_unknown", "info", "state", "none", "the stored scan has no policy beside it"))
        return out

    def report(self, reference: str) -> CommandResult:
        def work():
            report, path, _ = self.load_report(self._store(), reference)
            told = self._source(report, path)
            partial = any(d.impact == "degrades_coverage" for d in told)
            return CommandResult.resolve("report", "partial" if partial else "complete", [{"kind": "report", "run_id": report["run"]["run_id"], "path": path}], told, report)

        return self._guard("report", work)

    # --- plans

    def plan(self, reference: str, output: str | None = None) -> CommandResult:
        def work():
            store = self._store()
            report, path, manifest = self.load_report(store, reference)
            run_id = report["run"]["run_id"]
            target = os.path.abspath(output or os.path.join(os.path.dirname(os.path.abspath(path)), "plan-exact-duplicates.json"))
            spool = store.spool("plan")
            try:
                document = self._plan_document(report, manifest, spool)
                validate("plan", document)
                try:
                    publish.commit_plan(target, run_id, manifest["set_id"] if manifest else None, publish.Payload("plan", PLAN, os.path.basename(target), source=document["actions"].path))
                except OSError as error:
                    raise Refused(blocking("output_destination_invalid", "input", f"the plan can't be written there: {error}", path=target)) from error
            finally:
                shutil.rmtree(spool, ignore_errors=True)
            document["actions"].path = target
            told = self._source(report, path)
            partial = any(d.impact == "degrades_coverage" for d in told)
            artifacts = [{"kind": "plan", "run_id": run_id, "path": target}, {"kind": "artifact_set", "run_id": run_id, "path": publish.plan_marker(target)}]
            return CommandResult.resolve("plan", "partial" if partial else "complete", artifacts, told, document)

        return self._guard("plan", work)

    def _plan_document(self, report: dict, manifest: dict | None, spool: str) -> dict:
        """From the report alone, as it was stored; written to ``spool``, a path of a group at a time."""
        rows = self._facts(report["observations"], os.path.join(spool, "facts"))
        digest = blake3.blake3_udf()
        acts = cut(duplicates.actions(rows, digest), "actions")
        paths = cut(duplicates.paths(rows, digest, acts), "plan-paths")
        size, content, path = F.col("expected_size_bytes"), F.col("expected_content_hash"), F.col("path_key")
        of = (F.col("size_bytes"), F.col("content_hash"))

        def action(a: dict) -> str:
            head = {"action_id": publish.uuid7()} | {k: a[k] for k in ("group_id", "classification", "proposed_operation", "keep_path", "potential_reclaimable_bytes")}
            return _json(head | {"physical_reclaimability": {"status": a["reclaim_status"], "reason_codes": a["reasons"]}})[:-1] + ', "keep_alias_paths": ['

        def told(p: dict) -> str:
            return json.dumps(p["path_key"], ensure_ascii=False)

        lines = (
            documents.lines(acts, *of, 0, F.lit(""), action)
            .unionAll(documents.lines(paths.where("role = 'keep' and path_key <> keep_path"), size, content, 1, path, told))
            .unionAll(documents.marks(acts, *of, 2, '], "candidate_paths": ['))
            .unionAll(documents.lines(paths.where("role = 'candidate'"), size, content, 3, path, told))
            .unionAll(documents.marks(acts, *of, 4, '], "preconditions": ['))
            .unionAll(documents.lines(paths, size, content, 5, path, lambda p: _json({k: v for k, v in p.items() if k not in ("group_id", "role", "keep_path")})))
            .unionAll(documents.marks(acts, *of, 6, "]}"))
        )
        totals = acts.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("potential_reclaimable_bytes").cast("decimal(38,0)")), F.lit(0)).alias("bytes")).first()
        summary = {"action_count": totals.n, "candidate_file_count": paths.where("role = 'candidate'").count(), "potential_reclaimable_bytes": int(totals.bytes)}
        head = {
            "schema": PLAN, "plan_id": publish.uuid7(), "source_run_id": report["run"]["run_id"], "source_artifact_set_id": manifest["set_id"] if manifest else None,
            "created_at": publish.now(), "mode": "review_only", "safety": duplicates.SAFETY, "summary": summary,
        }
        document = documents.write(os.path.join(spool, "plan.json"), head, {"actions": lines}, spool)
        release(acts, paths)
        return document

    # --- the rest

    def cache_status(self) -> CommandResult:
        return self._guard("cache status", lambda: CommandResult.resolve("cache status", result=self._store().cache_status()))

    def doctor(self) -> CommandResult:
        def work():
            store = self._store()
            tools = [tool_status("ffprobe", "media metadata"), tool_status("ffmpeg", "nothing yet")]
            return CommandResult.resolve("doctor", result={"state_directory": store.folder, "state_ready": True, "state_version": store.version(), "tools": tools})

        return self._guard("doctor", work)

    def config(self, action: str, setting: str | None = None) -> CommandResult:
        def work():
            if action == "explain":
                return CommandResult.resolve("config explain", result=self.resolution.explain(setting))
            loaded = sum(s["status"] == "loaded" for s in self.resolution.sources)
            result = {"valid": True, "loaded_sources": loaded} if action == "validate" else self.resolution.policy | {"sources": self.resolution.sources, "shadowed": self.resolution.shadowed}
            return CommandResult.resolve(f"config {action}", result=result)

        return self._guard(f"config {action}", work)


_FACTS = (
    "observation_id string, path_key string, components array<string>, size_bytes bigint, modified_unix_ns bigint, content_hash string, filesystem_id string, file_id string, link_count bigint, "
    "allocated_size_bytes bigint, extent_sharing_status string, evidence_validity string"
)


def _fact(o: dict) -> tuple:
    identity, storage = o.get("filesystem_identity") or {}, o.get("storage_allocation") or {}
    key = o["path"].get("value") or f"\x00unix_bytes:{o['path']['base64']}"
    return (
        o.get("observation_id"), key, [c for i, c in enumerate(key.split("/")) if i == 0 or c not in ("", ".")], o["size_bytes"], o.get("modified_unix_ns"), o.get("content_hash"),
        identity.get("filesystem_id"), identity.get("file_id"), identity.get("link_count"), storage.get("allocated_size_bytes"), storage.get("extent_sharing_status"), o["evidence_validity"],
    )


def _json(row: dict) -> str:
    return json.dumps(_plain(row), ensure_ascii=False)


def _checked(row: dict) -> str:
    """The JSON of an observation that keeps the report's contract."""
    value = _plain(row)
    if found := next(problems(SCHEMAS["report"]["properties"]["observations"]["items"], value), None):
        raise ContractError(f"report: {found}")
    return json.dumps(value, ensure_ascii=False)


def _current(o: dict) -> dict:
    """An observation in the current shape."""
    o = o | {k: v for k, v in OBSERVATION_DEFAULTS.items() if o.get(k) is None}
    # a text is from before paths were lossless
    return o | {"path": {"encoding": "utf8", "value": o["path"]}} if isinstance(o.get("path"), str) else o


def decode_report(path: str) -> dict:
    """A stored report in the current shape: what its version lacked gets its default.  Long lists stay in the file."""
    try:
        report = documents.load(path)
    except OSError as error:
        raise Refused(blocking("stored_state_incompatible", "state", f"the report can't be read: {error}", path=path)) from error
    except ValueError as error:
        raise Refused(blocking("invalid_command_input", "input", f"the report isn't JSON: {error}", path=path)) from error
    if not isinstance(report, dict) or report.get("schema") not in REPORT_VERSIONS:
        raise Refused(blocking("stored_state_incompatible", "state", "the report has an unknown version", path=path))
    report["summary"] = SUMMARY_DEFAULTS | report.get("summary", {})
    observations = report.get("observations")
    if isinstance(observations, documents.Items):
        observations.each = _current
    elif observations is not None:
        report["observations"] = [_current(o) for o in observations]
    report.setdefault("hard_link_groups", [])
    report.setdefault("storage", None)
    if report["schema"] == REPORT:
        try:
            validate("report", report)
        except ContractError as error:
            raise Refused(blocking("stored_state_incompatible", "state", str(error), path=path)) from error
    return report
