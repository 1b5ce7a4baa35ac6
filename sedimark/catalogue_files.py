"""Registered queries that run scans, publication, state, policy, tools and portals for real.

The documents become files in the scratch folder: each text in ``source/lang/doc_id.txt``; every tenth has a
hard link in ``links``; beside some stand hidden names and symbolic links, which a scan leaves out.  What the
commands then say is returned as rows, and SQL over the tables says what it must be.
"""

from __future__ import annotations

import contextlib
import gzip
import json
import os
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark import cli
from sedimark.functions import blake3, media
from sedimark.functions import paths as path_functions
from sedimark.operators import cache, diagnostics, graph, relate
from sedimark.runs import documents, policy, publish
from sedimark.runs.contracts import SCHEMAS, problems
from sedimark.runs.engine import Engine, Signals
from sedimark.runs.outcome import CommandResult, Diagnostic, Refused, blocking, coalesced, escaped, human
from sedimark.runs.state import MIGRATIONS, StateStore
from sedimark.schemas import column_names
from sedimark.sources import filesystem, observe, pages, portal, processes
from sedimark.storage import scratch_path
from sedimark.streaming import incremental

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _register(sql: str):
    def add(function):
        _QUERIES[function.__name__] = function
        _SQL[function.__name__] = sql
        return function

    return add


def _folder(spark: SparkSession, label: str) -> str:
    """A scratch folder as a local path; the tests' executors see the same file system."""
    path = scratch_path(spark, label)
    if "://" in path and not path.startswith("file:"):
        raise ValueError("scans of a tree need a scratch folder in a file system")
    path = "/" + path.removeprefix("file:").lstrip("/")
    os.makedirs(path, exist_ok=True)
    return path


def _tree(spark: SparkSession, sf_dir: str) -> str:
    """The documents as files; a task that is run again replaces what it wrote."""
    root = _folder(spark, "tree")
    for name in ("links", "state"):
        os.makedirs(f"{root}/{name}")
    with open(f"{root}/state/inside", "w") as f:
        f.write("never scanned")

    def put(path: str, make) -> None:
        if os.path.lexists(path):
            os.unlink(path)
        make(path)

    def write(batches):
        for batch in batches:
            for doc_id, source, lang, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "source", "lang", "text"))):
                folder = f"{root}/{source}/{lang}"
                os.makedirs(folder, exist_ok=True)
                path = f"{folder}/{doc_id}.txt"

                def content(at, text=text):
                    with open(at, "wb") as f:
                        f.write((text or "").encode())

                put(path, content)
                if doc_id % 10 == 0:
                    put(f"{root}/links/{doc_id}.txt", lambda at, path=path: os.link(path, at))
                if doc_id % 50 == 0:
                    put(f"{folder}/.{doc_id}", content)
                if doc_id % 25 == 0:
                    put(f"{folder}/{doc_id}.lnk", lambda at, path=path: os.symlink(path, at))
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    docs.mapInArrow(write, "n long").agg(F.sum("n")).collect()
    return root


#: The files that a scan of the tree must find, as common table expressions.
_FILES_SQL = """
with docs as (
  select doc_id, coalesce(text, '') as text, cast(octet_length(encode(coalesce(text, ''))) as bigint) as size_bytes,
         '/' || source || '/' || lang || '/' || doc_id || '.txt' as own, case when doc_id % 10 = 0 then 2 else 1 end as link_count from documents),
files as (
  select doc_id, text, size_bytes, own as path, link_count from docs
  union all select doc_id, text, size_bytes, '/links/' || doc_id || '.txt', link_count from docs where doc_id % 10 = 0),
objects as (
  select doc_id, text, size_bytes, min(path) as primary_path, count(*) as observed from files group by all),
groups as (
  select text, size_bytes, count(*) as member_count, sum(observed) as observed_path_count, min(primary_path) as keep_path
  from objects group by text, size_bytes having count(*) > 1)
"""


def _relative(root: str, column="path_key"):
    return F.substring(F.col(column), len(root) + 1, 1 << 20)


def _scanned(spark, sf_dir) -> tuple[str, filesystem.Discovery]:
    root = _tree(spark, sf_dir)
    roots = [root, f"{root}/links", root, f"{root}/./links"]
    return root, filesystem.discover(spark, roots, filesystem.ScanOptions(probe_media=False), f"{root}/state")


@_register(_FILES_SQL + "select path, size_bytes, cast(link_count as bigint) as link_count, true as known from files")
def file_inventory(spark, sf_dir):
    """Every file once, however roots overlap; no hidden name, link or state file."""
    root, found = _scanned(spark, sf_dir)
    known = F.col("inode").isNotNull() & F.col("device_id").isNotNull() & (F.col("modified_unix_ns") > 0) & (F.col("changed_unix_ns") > 0)
    return found.files.select(_relative(root).alias("path"), "size_bytes", "link_count", known.alias("known"))


@_register(
    "select * from (values ('/absent', 'input_unavailable', 'filenotfound', 'partial_inventory', 'warning', 'observation', 'degrades_coverage'), "
    "('/link', 'input_excluded_by_policy', null, 'partial_inventory', 'warning', 'input', 'degrades_coverage'), "
    "('/pipe', 'invalid_input_type', null, 'partial_inventory', 'warning', 'observation', 'degrades_coverage')) t(path, kind, os_error_kind, code, severity, classification, impact)"
)
def scan_issues(spark, sf_dir):
    """Inputs that can't be scanned, as issues and as diagnostics."""
    root = _tree(spark, sf_dir)
    os.symlink(root, f"{root}/link")
    os.mkfifo(f"{root}/pipe")
    found = filesystem.discover(spark, [root, f"{root}/absent", f"{root}/link", f"{root}/pipe"], filesystem.ScanOptions(probe_media=False), f"{root}/state")
    told = diagnostics.from_issues(found.issues, bool(found.accepted)).select("path", "os_error_kind", "code", "severity", "classification", "impact")
    return found.issues.select("path", "kind").join(told, "path").withColumn("path", _relative(root, "path"))


_OBSERVED_SQL = (
    "select path, size_bytes, hashed as has_hash, case when hashed then min(path) over (partition by text) end as first_of_content, case when hashed then 'blake3' end as hash_algorithm, "
    "'stable' as observation_stability, 'current' as evidence_validity, cast(1 as bigint) as attempt_count, cast(link_count as bigint) as link_count, false as cache_hit, "
    "1 as identity_available, 1 as allocation_available, size_bytes as logical_size_bytes, 'st_blocks512' as allocation_source, 'run' as run_id, 'unknown' as media_kind, 'unsupported' as status, 0 as warnings "
    "from (select *, count(*) over (partition by size_bytes) > 1 as hashed from files)"
)


@_register(_FILES_SQL + _OBSERVED_SQL)
def file_observations(spark, sf_dir):
    """Observations bound to open files: hashes for shared sizes alone, and equal hashes for equal contents."""
    root, found = _scanned(spark, sf_dir)
    wanted = observe.with_needs(found.files).withColumn("cache_hit", F.lit(False))
    stored = f"{_folder(spark, 'observed')}/observations"
    observe.observe(wanted, filesystem.ScanOptions(probe_media=False), "run").write.parquet(stored)
    rows = spark.read.parquet(stored)
    flags = relate.facts(rows).select("observation_id", "link_count", "identity_available", "allocation_available")
    path = _relative(root)
    firsts = rows.where("content_hash is not null").groupBy("content_hash").agg(F.min(path).alias("first_of_content"))
    return rows.join(firsts, "content_hash", "left").join(flags, "observation_id").select(
        path.alias("path"), "size_bytes", F.col("content_hash").isNotNull().alias("has_hash"), "first_of_content", "hash_algorithm", "observation_stability", "evidence_validity", "attempt_count", "link_count",
        "cache_hit", "identity_available", "allocation_available", F.col("storage_allocation.logical_size_bytes").alias("logical_size_bytes"),
        F.col("storage_allocation.allocation_source").alias("allocation_source"), "run_id", "media_kind", "status", F.size("warnings").alias("warnings"),
    )


@_register(_FILES_SQL + "select path, 'stable' as stability, min(path) over (partition by text) as first_of_content, true as verified from files")
def path_hashes(spark, sf_dir):
    """Every file hashed by its path, with proof that it stayed the same, and verified again by size and hash."""
    root, found = _scanned(spark, sf_dir)

    def work(batches):
        for batch in batches:
            raws, keys, sizes = ([path_functions.to_bytes(x) for x in batch.column("path").to_pylist()], batch.column("path_key"), batch.column("size_bytes").to_pylist())
            digests, kinds = zip(*observe.hash_paths(raws)) if raws else ((), ())
            verified = list(observe.have_content(list(zip(raws, sizes, digests))))
            yield pa.RecordBatch.from_arrays([keys, pa.array(digests, pa.string()), pa.array(kinds, pa.string()), pa.array(verified, pa.bool_())], names=["path_key", "digest", "stability", "verified"])

    spread = found.files.select("path", "path_key", "size_bytes").repartition(4 * spark.sparkContext.defaultParallelism)
    hashed = spread.mapInArrow(work, "path_key string, digest string, stability string, verified boolean")
    path = _relative(root)
    firsts = hashed.groupBy("digest").agg(F.min(path).alias("first_of_content"))
    return hashed.join(firsts, "digest").select(path.alias("path"), "stability", "first_of_content", "verified")


def _engine(spark, root: str) -> Engine:
    line = {"operational_policy.state_directory": f"{root}/state", "evidence_policy.probe_media": False}
    return Engine(spark, policy.resolve(line, no_config=True, environment={"HOME": root}), Signals())


def _rows(spark, rows: list[tuple], ddl: str) -> DataFrame:
    return spark.createDataFrame(rows, ddl)


@_register(
    _FILES_SQL
    + "select scan, name, value from (select unnest([1, 2]) as scan), (select unnest(['file_count', 'total_bytes', 'exact_duplicate_groups', 'exact_duplicate_files', 'reclaimable_bytes', 'unique_object_count', "
    "'hard_link_alias_path_count', 'unstable_observation_count', 'unreadable_files', 'path_logical_bytes', 'unique_object_logical_bytes', 'hard_link_groups', 'observations', 'cache_hits']) as name, "
    "cast(unnest([(select count(*) from files), (select sum(size_bytes) from files), (select count(*) from groups), (select coalesce(sum(member_count), 0) from groups), "
    "(select coalesce(sum(size_bytes * (member_count - 1)), 0) from groups), (select count(*) from objects), (select count(*) from files) - (select count(*) from objects), 0, 0, "
    "(select sum(size_bytes) from files), (select sum(size_bytes) from objects), (select count(*) from objects where observed > 1), (select count(*) from files), 0]) as bigint) as value) "
    "where name <> 'cache_hits' union all select 1, 'cache_hits', 0 union all select 2, 'cache_hits', count(*) from files"
)
def scan_reports(spark, sf_dir):
    """The published reports of two scans; the second takes all analyses from the cache."""
    root = _tree(spark, sf_dir)
    engine, out = _engine(spark, root), []
    for scan in (1, 2):
        report = engine.report(engine.scan([root]).result["run"]["run_id"]).result
        told = report["summary"] | {k: report["storage"][k] for k in ("path_logical_bytes", "unique_object_logical_bytes")}
        told |= {"hard_link_groups": len(report["hard_link_groups"]), "observations": len(report["observations"])}
        wanted = ("file_count", "total_bytes", "exact_duplicate_groups", "exact_duplicate_files", "reclaimable_bytes", "unique_object_count", "hard_link_alias_path_count", "unstable_observation_count",
                  "unreadable_files", "path_logical_bytes", "unique_object_logical_bytes", "hard_link_groups", "observations", "cache_hits")
        out += [(scan, k, int(told[k])) for k in wanted]
    return _rows(spark, out, "scan int, name string, value long")


@_register(
    _FILES_SQL
    + "select keep_path, cast(member_count as bigint) as member_count, (select string_agg(o.primary_path, ' ' order by o.primary_path) from objects o where o.text = g.text and o.primary_path <> g.keep_path) as candidates, "
    "cast(size_bytes * (member_count - 1) as bigint) as reclaimable_bytes, cast(observed_path_count as bigint) as preconditions, 'review_duplicates' as operation, false as mutates_files from groups g"
)
def scan_plan(spark, sf_dir):
    """The actions of the plan that follows a scan, as it was published."""
    root = _tree(spark, sf_dir)
    engine = _engine(spark, root)
    run = engine.scan([root]).result["run"]["run_id"]
    target = f"{_folder(spark, 'plan')}/plan.json"
    engine.plan(run, target)
    assert publish.inspect_plan(target).status == "committed"
    plan, report = documents.load(target), engine.report(run).result
    told = f"{_folder(spark, 'actions')}/actions.json"
    with open(told, "w") as f:
        # both are ordered by size and content; aliases of candidates aren't members
        for a, g in zip(plan["actions"], report["duplicate_groups"], strict=True):
            assert a["group_id"] == g["group_id"]
            primaries = {m["primary_path"] for m in g["members"]}
            own = sorted(p for p in a["candidate_paths"] if p in primaries)
            row = {"keep_path": a["keep_path"][len(root) :], "member_count": 1 + len(own), "candidates": " ".join(p[len(root) :] for p in own), "reclaimable_bytes": a["potential_reclaimable_bytes"]}
            row |= {"preconditions": len(a["preconditions"]), "operation": a["proposed_operation"], "mutates_files": plan["safety"]["mutates_files"]}
            f.write(json.dumps(row) + "\n")
    return spark.read.schema("keep_path string, member_count long, candidates string, reclaimable_bytes long, preconditions long, operation string, mutates_files boolean").json(told)


@_register(
    _FILES_SQL
    + "select 'whole' as set, 'committed' as status, 0 as exit_code, (select count(*) from groups) as groups union all select 'crashed', 'completed', 0, (select count(*) from groups) "
    "union all select 'interrupted', 'interrupted', 5, null union all select 'a member is gone', 'incomplete', 5, null union all select 'a member is changed', 'incomplete', 5, null "
    "union all select 'another marker', 'incompatible', 5, null union all select 'a second set', 'refused', null, null union all select 'no such run', 'unknown', 5, null"
)
def artifact_sets(spark, sf_dir):
    """What becomes of published sets, crashes, signals and damage; stored groups by run."""
    root = _tree(spark, sf_dir)
    engine = _engine(spark, root)
    store = StateStore(spark, engine.state_directory)

    class Crash(BaseException):
        pass

    def at(stage, act):
        def hook(now):
            if now == stage:
                act()

        return hook

    def crash():
        raise Crash

    def signalled():
        engine.signals.caught = 2

    whole = engine.scan([root]).result["run"]["run_id"]
    with contextlib.suppress(Crash):
        engine.scan([root], at("published", crash))
    crashed = next(r["run_id"] for r in store.runs() if r["status"] == "running")
    engine._store()
    stopped = engine.scan([root], at("observed", signalled)).diagnostics[0]["context"]["run_id"]
    engine.signals.caught = None
    out = [("whole", publish.inspect_scan(store.run_folder(whole)).status, engine.report(whole).exit_code, store.table("duplicate_groups", whole).count())]
    out.append(("crashed", store.status(crashed), engine.report(crashed).exit_code, store.table("duplicate_groups", crashed).count()))
    out.append(("interrupted", store.status(stopped), engine.report(stopped).exit_code, None))
    folder = store.run_folder(whole)
    try:
        publish.commit_scan(folder, whole, "s", [publish.Payload.of(k, k, f"{k}.json", {"schema": k}) for k in publish.SCAN_KINDS])
        out.append(("a second set", "written", None, None))
    except FileExistsError:
        out.append(("a second set", "refused", None, None))
    with open(f"{folder}/run.json", "rb") as f:
        run = f.read()
    with open(f"{folder}/run.json", "ab") as f:
        f.write(b" ")
    out.append(("a member is changed", publish.inspect_scan(folder).status, engine.report(whole).exit_code, None))
    os.unlink(f"{folder}/run.json")
    out.append(("a member is gone", publish.inspect_scan(folder).status, engine.report(whole).exit_code, None))
    with open(f"{folder}/run.json", "wb") as f:
        f.write(run)
    with open(f"{folder}/{publish.MARKER}", "w") as f:
        f.write('{"schema": "other"}')
    out.append(("another marker", publish.inspect_scan(folder).status, engine.report(whole).exit_code, None))
    unknown = publish.uuid7()
    out.append(("no such run", store.status(unknown) or "unknown", engine.report(unknown).exit_code, None))
    return _rows(spark, out, "set string, status string, exit_code int, groups long")


@_register(
    "select * from (values (1, 'running', 'completed', true, 'completed'), (2, 'running', 'interrupted', true, 'interrupted'), (3, 'running', 'failed', true, 'failed'), "
    "(4, 'completed', 'failed', false, 'completed'), (5, 'interrupted', 'completed', false, 'interrupted'), (6, null, 'completed', false, null)) t(n, before, wanted, turned, after)"
)
def run_states(spark, sf_dir):
    """The states of a run: it ends once, and an end stays."""
    store = StateStore(spark, _folder(spark, "state")).open()
    out = []
    for n, (before, wanted) in enumerate((("running", "completed"), ("running", "interrupted"), ("running", "failed"), ("completed", "failed"), ("interrupted", "completed"), (None, "completed")), 1):
        if before:
            store.begin(f"r{n}", publish.now())
            if before != "running":
                store.mark(f"r{n}", before)
        out.append((n, before, wanted, store.mark(f"r{n}", wanted), store.status(f"r{n}")))
    return _rows(spark, out, "n int, before string, wanted string, turned boolean, after string")


_POLICY_SQL = "select * from (values " + ", ".join(
    f"('{name}', '{value}', '{source}', {shadowed}, {locked})"
    for name, value, source, shadowed, locked in (
        ("evidence_policy.follow_symlinks", "true", "user_config", 1, "false"), ("evidence_policy.include_hidden", "false", "environment", 2, "false"), ("evidence_policy.cross_filesystems", "true", "command_line", 1, "false"),
        ("evidence_policy.probe_media", "true", "default", 0, "false"), ("operational_policy.state_directory", "/work/inner/line", "command_line", 4, "false"), ("presentation_policy.output_format", "json", "environment", 1, "false"),
        ("evidence_policy.exact_grouping_profile", "blake3_complete_content", "locked_invariant", 0, "true"), ("evidence_policy.observation_stability", "required", "locked_invariant", 0, "true"),
        ("evidence_policy.unstable_observations", "exclude", "locked_invariant", 0, "true"), ("evidence_policy.maximum_observation_attempts", "2", "locked_invariant", 0, "true"),
        ("safety_invariants.source_mutation", "false", "locked_invariant", 0, "true"), ("safety_invariants.apply_enabled", "false", "locked_invariant", 0, "true"), ("safety_invariants.shell_execution", "false", "locked_invariant", 0, "true"),
        ("safety_invariants.artifact_validation_required", "true", "locked_invariant", 0, "true"), ("safety_invariants.atomic_artifact_commit_required", "true", "locked_invariant", 0, "true"),
        ("safety_invariants.current_stability_required_for_exact_groups", "true", "locked_invariant", 0, "true"),
    )
) + ") t(setting, value, source, shadowed, locked)"


@_register(_POLICY_SQL)
def policy_settings(spark, sf_dir):
    """Defaults, user file, project file, environment and command line, laid over one another; what each hid."""
    top = _folder(spark, "policy")
    os.makedirs(f"{top}/home/.config/sedimark")
    os.makedirs(f"{top}/work/inner")
    with open(f"{top}/home/.config/sedimark/config.toml", "w") as f:
        f.write('schema = "sedimark.config.v1"\n[scan]\nfollow_symlinks = true\ninclude_hidden = true\n[state]\ndirectory = "user"\n')
    with open(f"{top}/work/sedimark.toml", "w") as f:
        f.write('schema = "sedimark.config.v1"\n[state]\ndirectory = "project"\n')
    environment = {"HOME": f"{top}/home", "SEDIMARK_STATE_DIRECTORY": "env", "SEDIMARK_INCLUDE_HIDDEN": "false", "SEDIMARK_OUTPUT_FORMAT": "json"}
    got = policy.resolve({"state.directory": "line", "scan.cross_filesystems": True}, environment=environment, folder=f"{top}/work/inner")
    policy.verify_fingerprints(got.policy)
    out = []
    for name in (*policy.SETTINGS, *policy.LOCKED):
        told = got.explain(name)
        text = json.dumps(told["value"]).strip('"').replace(top, "")
        out.append((name, text, told["source"], len(told["shadowed"]), told["locked"]))
    return _rows(spark, out, "setting string, value string, source string, shadowed int, locked boolean")


_BAD_CONFIGURATIONS = (
    ("open bracket", "[scan", "configuration_parse_failed"), ("no schema", "x = 1", "configuration_schema_missing"), ("another schema", 'schema = "other"', "configuration_schema_unsupported"),
    ("unknown key", 'schema = "sedimark.config.v1"\nmore = 1', "configuration_unknown_key"), ("text for a boolean", 'schema = "sedimark.config.v1"\n[scan]\nprobe_media = "yes"', "configuration_value_invalid"),
    ("unknown format", 'schema = "sedimark.config.v1"\n[output]\nformat = "xml"', "configuration_value_invalid"),
)


@_register(
    "select * from (values " + ", ".join(f"('{name}', '{code}')" for name, _, code in _BAD_CONFIGURATIONS) + ", ('a link', 'configuration_not_regular_file'), ('absent', 'configuration_not_found'), "
    "('both selectors', 'configuration_selector_conflict'), ('odd environment', 'configuration_environment_invalid'), ('unknown setting', 'configuration_setting_unknown'), "
    "('changed fingerprint', 'effective_policy_fingerprint_mismatch')) t(name, code)"
)
def policy_refusals(spark, sf_dir):
    top = _folder(spark, "policy")
    out = []

    def refused(name: str, work) -> None:
        try:
            work()
            out.append((name, None))
        except Refused as error:
            out.append((name, error.diagnostic.code))

    home = {"environment": {"HOME": top}, "folder": top}
    for i, (name, body, _) in enumerate(_BAD_CONFIGURATIONS):
        with open(f"{top}/{i}.toml", "w") as f:
            f.write(body)
        refused(name, lambda i=i: policy.resolve(config=f"{i}.toml", **home))
    os.symlink(f"{top}/0.toml", f"{top}/link.toml")
    refused("a link", lambda: policy.resolve(config="link.toml", **home))
    refused("absent", lambda: policy.resolve(config="absent.toml", **home))
    refused("both selectors", lambda: policy.resolve(config="a", no_config=True, **home))
    refused("odd environment", lambda: policy.resolve(environment={"HOME": top, "SEDIMARK_PROBE_MEDIA": "1"}, folder=top))
    refused("unknown setting", lambda: policy.resolve({"no.such": 1}, **home))
    changed = policy.resolve(no_config=True, **home).policy | {"presentation_policy": {"output_format": "json"}}
    refused("changed fingerprint", lambda: policy.verify_fingerprints(changed))
    return _rows(spark, out, "name string, code string")


@_register(
    "select * from (values ('nothing', 'success', 0, 0), ('partial', 'partial_success', 3, 0), ('partial without a result', 'internal_failure', 1, 0), ('degraded', 'partial_success', 3, 1), ('input', 'invalid_input', 2, 1), "
    "('capability', 'capability_unavailable', 4, 1), ('state and input', 'stale_state', 5, 2), ('artifact', 'internal_failure', 1, 1), ('terminated and internal', 'terminated', 143, 2), ('interrupted and terminated', 'interrupted', 130, 2), "
    "('repeated', 'invalid_input', 2, 1)) t(name, outcome, exit_code, shown)"
)
def command_outcomes(spark, sf_dir):
    """Class and exit code that follow from diagnostics, gravest first; equal diagnostics become one."""
    weak = Diagnostic("result_produced_with_exclusions", "warning", "observation", "degrades_coverage", "m")
    cases = (
        ("nothing", {}), ("partial", {"coverage": "partial", "result": {}}), ("partial without a result", {"coverage": "partial"}), ("degraded", {"diagnostics": [weak], "result": {}}), ("input", {"diagnostics": [blocking("a", "input", "m")]}),
        ("capability", {"diagnostics": [blocking("a", "capability", "m")]}), ("state and input", {"diagnostics": [blocking("a", "state", "m"), blocking("b", "input", "m")]}), ("artifact", {"diagnostics": [blocking("a", "artifact", "m")]}),
        ("terminated and internal", {"diagnostics": [blocking("operation_terminated", "operation", "m"), blocking("b", "internal", "m")]}),
        ("interrupted and terminated", {"diagnostics": [blocking("operation_terminated", "operation", "m"), blocking("operation_interrupted", "operation", "m")]}), ("repeated", {"diagnostics": [blocking("a", "input", "m")] * 3}),
    )
    got = [(name, CommandResult.resolve("c", **told)) for name, told in cases]
    return _rows(spark, [(name, r.outcome, r.exit_code, len(coalesced([Diagnostic(**d) for d in r.diagnostics]))) for name, r in got], "name string, outcome string, exit_code int, shown int")


@_register(
    _FILES_SQL
    + "select 'bogus' as line, 2 as exit_code, 'invalid_invocation' as code, null as told union all select 'config explain', 0, null, 'evidence_policy.probe_media' union all select 'config validate', 0, null, 'true' "
    "union all select 'scan', 0, null, (select count(*)::varchar from files) union all select 'report', 0, null, (select count(*)::varchar from files) union all select 'plan', 0, null, (select count(*)::varchar from groups) "
    "union all select 'cache status', 0, null, '1' union all select 'doctor', 0, null, 'true' union all select 'scan of nothing', 2, 'invalid_command_input', null"
)
def command_line(spark, sf_dir):
    """The commands as their lines give them, JSON envelopes read back from where they were printed, compressed."""
    root = _tree(spark, sf_dir)
    before = ["--no-config", "--json", "--state-directory", f"{root}/state"]

    def run(*line: str) -> dict:
        result, shape = cli.run([*before, *line], spark)
        assert shape == "json"
        printed = f"{_folder(spark, 'printed')}/envelope.json.gz"
        with gzip.open(printed, "wt", 1, "utf-8") as f:
            f.writelines(documents.pieces(result.as_dict()))
        envelope = documents.load(printed, gzip.open)  # reads it to its end; nothing asks for the long lists again
        os.unlink(printed)
        return envelope

    scan = run("scan", "--no-probe", root)
    run_id = scan["result"]["run"]["run_id"]
    told = (
        ("bogus", run("bogus"), lambda r: None), ("config explain", run("config", "explain", "scan.probe_media"), lambda r: r["setting"]), ("config validate", run("config", "validate"), lambda r: json.dumps(r["valid"])),
        ("scan", scan, lambda r: str(r["summary"]["file_count"])), ("report", run("report", run_id), lambda r: str(r["summary"]["file_count"])),
        ("plan", run("plan", "exact-duplicates", "--run", run_id, "--output", f"{_folder(spark, 'plan')}/plan.json"), lambda r: str(r["summary"]["action_count"])),
        ("cache status", run("cache", "status"), lambda r: str(r["completed_runs"])), ("doctor", run("doctor"), lambda r: json.dumps(r["state_ready"])), ("scan of nothing", run("scan", f"{root}/absent"), lambda r: None),
    )
    return _rows(spark, [(line, e["exit_code"], next((d["code"] for d in e["diagnostics"] if d["severity"] == "error"), None), show(e["result"]) if e["result"] else None) for line, e, show in told], "line string, exit_code int, code string, told string")


@_register(
    "select * from (values ('plain', 'ok', 3, false), ('long output', 'ok', 10, true), ('slow', 'timeout', null, null), ('absent', 'not_found', null, null), ('failing', 'exit_status', null, null), ('not json', 'invalid_json', null, null), "
    "('too long for json', 'output_truncated', null, null), ('cancelled', 'cancelled', null, null), ('no limits', 'invalid_limits', null, null), ('no place', 'queue_timeout', null, null)) t(name, kind, kept, truncated)"
)
def external_tools(spark, sf_dir):
    """Bounded tools: output, time, places and typed failures."""
    import threading
    import time

    def runner(**limits):
        return processes.Runner(processes.Limits(**{"timeout": 0.4, "stdout": 10} | limits))

    busy = runner(children=1, timeout=1.5)
    occupied = threading.Thread(target=lambda: _quiet(lambda: busy.run(["sleep", "1.2"])), daemon=True)

    def no_place():
        occupied.start()
        time.sleep(0.2)
        return _short(busy).run(["true"])

    cases = (
        ("plain", lambda: runner().run(["printf", "abc"])), ("long output", lambda: runner().run(["printf", "123456789012345"])), ("slow", lambda: runner().run(["sleep", "5"])), ("absent", lambda: runner().run(["no-such-tool"])),
        ("failing", lambda: runner().run_json(["false"])), ("not json", lambda: runner().run_json(["printf", "x"])), ("too long for json", lambda: runner().run_json(["printf", "123456789012345"])),
        ("cancelled", lambda: runner().run(["sleep", "5"], cancelled=lambda: True)), ("no limits", lambda: runner(timeout=0)), ("no place", no_place),
    )
    out = []
    for name, work in cases:
        try:
            got = work()
            out.append((name, "ok", len(got.stdout), got.stdout_truncated))
        except processes.ToolError as error:
            out.append((name, error.kind, None, None))
    occupied.join()
    return _rows(spark, out, "name string, kind string, kept int, truncated boolean")


def _quiet(work) -> None:
    with contextlib.suppress(processes.ToolError):
        work()


def _short(runner: processes.Runner) -> processes.Runner:
    """The same places with little time to wait for one."""
    out = processes.Runner(processes.Limits(timeout=0.2))
    out._permits = runner._permits
    return out


def _portal(spark, sf_dir, spoil: bool = False) -> tuple[str, str]:
    """Regions and nations as documents with front matter: a nation depends on its region and is related to the nation before it."""
    folder = _folder(spark, "portal")
    regions = spark.read.parquet(f"{sf_dir}/region.parquet").collect()
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").collect()

    def write(name: str, title: str, depends: list[str], related: list[str]) -> None:
        fields = {"schema": portal.DOCUMENT_SCHEMA, "id": name, "title": title, "kind": "document", "version": "1", "status": "current", "created": "2024-01-01", "updated": "2024-01-02"}
        lists = {k: [] for k in portal.LISTS} | {"owners": ["ada"], "depends_on": depends, "related": related}
        header = "".join(f"{k}: {v}\n" for k, v in fields.items()) + "".join(f"{k}: []\n" if not v else f"{k}:\n" + "".join(f"  - {x}\n" for x in v) for k, v in lists.items())
        with open(f"{folder}/{name}.md", "w") as f:
            f.write(f"---\n{header}---\n# {title}\n")

    for r in regions:
        write(f"region-{r.r_regionkey}", r.r_name, [], [])
    for n in nations:
        lost = spoil and n.n_nationkey % 5 == 0
        write(f"nation-{n.n_nationkey}", n.n_name, ["region-99" if lost else f"region-{n.n_regionkey}"], [f"nation-{n.n_nationkey - 1}"] if n.n_nationkey else [])
    members = {r.r_regionkey: [f"region-{r.r_regionkey}"] for r in regions}
    for n in nations:
        if not (spoil and n.n_nationkey % 7 == 0):
            members[n.n_regionkey].append(f"nation-{n.n_nationkey}")
    config = {
        "schema": "c", "repository": {"sourceUrl": "https://example.org/r", "revision": "main"}, "product": {"name": "x"}, "runtimeLayers": [{"id": "l", "title": "L"}], "platformBoundaries": [],
        "categories": [{"id": f"c{k}", "title": str(k), "documentIds": ids} for k, ids in members.items()],
    }
    with open(f"{folder}/portal.json", "w") as f:
        json.dump(config, f)
    return folder, f"{folder}/portal.json"


@_register(
    "with d as (select 'region-' || r_regionkey as id, r_name as title, 'c' || r_regionkey as category, 0 as rank, '' as depends_on from region union all "
    "select 'nation-' || n_nationkey, n_name, 'c' || n_regionkey, 1, 'region-' || n_regionkey from nation) "
    "select id, title, category, rank, depends_on, 'https://example.org/r/blob/main/' || id || '.md' as source_url from d"
)
def portal_cards(spark, sf_dir):
    folder, config = _portal(spark, sf_dir)
    data = portal.load(spark, folder, config).dataset()
    return _rows(spark, [(d["id"], d["title"], d["category"], d["rank"], " ".join(d["depends_on"]), d["source_url"]) for d in data["documents"]], "id string, title string, category string, rank int, depends_on string, source_url string")


@_register("select (select count(*) from region) as categories, 1 as layers, (select count(*) from region) + (select count(*) from nation) as documents, (select count(*) from nation) as dependencies")
def portal_stats(spark, sf_dir):
    folder, config = _portal(spark, sf_dir)
    return portal.load(spark, folder, config).stats().withColumn("categories", F.col("categories").cast("long"))


@_register(
    "with d as (select 'region-' || r_regionkey as id, r_name as title, 0 as rank from region union all select 'nation-' || n_nationkey, n_name, 1 from nation), "
    "n as (select *, row_number() over (partition by rank order by title, id) - 1 as place, count(*) over (partition by rank) as rows from d), "
    "p as (select id, rank * 200.0 as x, ((select max(rows) from n) - rows) * 45.0 + place * 90.0 as y from n) "
    "select 'nation-' || n_nationkey as target, 'region-' || n_regionkey as source, a.x::double as x1, a.y::double as y1, b.x::double as x2, b.y::double as y2 "
    "from nation join p a on a.id = 'region-' || n_regionkey join p b on b.id = 'nation-' || n_nationkey"
)
def portal_layout(spark, sf_dir):
    """Edges of the dependency graph with the places of both ends."""
    folder, config = _portal(spark, sf_dir)
    return portal.load(spark, folder, config).layout()[1]


@_register("select 'nation-' || n_nationkey as id, n_name as title from nation where n_regionkey = 1 union all select 'region-1', r_name from region where r_regionkey = 1")
def portal_category(spark, sf_dir):
    folder, config = _portal(spark, sf_dir)
    return portal.load(spark, folder, config).in_category("c1").select("id", "title")


@_register(
    "select * from (values ('whole', null, true), ('two sources', 'two sources bring /index.html', true), ('broken link', '/index.html: gone.html', true), ('broken anchor', '/index.html: #gone', true), ('whole again', null, true)) t(site, problem, shown)"
)
def site_builds(spark, sf_dir):
    """The portal's page composed with another folder; a site with a fault leaves the one before in place."""
    folder, config = _portal(spark, sf_dir)
    top = _folder(spark, "site")
    page = portal.load(spark, folder, config).page()

    def source(name: str, **files: str) -> str:
        os.makedirs(f"{top}/{name}")
        for file, text in files.items():
            with open(f"{top}/{name}/{file}.html", "w") as f:
                f.write(text)
        return f"{top}/{name}"

    main = source("main", index=page + '<a href="docs/more.html#here">')
    more = source("more", more='<p id="here"><a href="../index.html">')
    cases = (
        ("whole", {"/": main, "/docs": more}), ("two sources", {"/": main, "//": source("twice", index="x"), "/docs": more}), ("broken link", {"/": source("lost", index='<a href="gone.html">')}),
        ("broken anchor", {"/": source("adrift", index='<a href="#gone">')}), ("whole again", {"/": main, "/docs": more}),
    )
    out = []
    for name, mounts in cases:
        try:
            portal.compose_site(spark, f"{top}/public", mounts)
            problem = None
        except portal.PortalError as error:
            problem = str(error)
            assert os.path.exists(f"{top}/public/index.html"), problem
        with open(f"{top}/public/index.html") as f:
            out.append((name, problem, f.read().startswith(page) and sorted(os.listdir(top)) == sorted({"public", "main", "more", "twice", "lost", "adrift"})))
    return _rows(spark, out, "site string, problem string, shown boolean")


@_register(
    "select 'unknown' as problem, 'nation-' || n_nationkey as id, 'region-99' as about from nation where n_nationkey % 5 = 0 union all select 'missing', 'nation-' || n_nationkey, null from nation where n_nationkey % 7 = 0"
)
def portal_problems(spark, sf_dir):
    """References to documents that aren't there, and documents in no category."""
    folder, config = _portal(spark, sf_dir, spoil=True)
    found = portal.documents(spark, folder)
    lost = portal.reference_problems(found).where("relation = 'depends_on'").select(F.lit("unknown").alias("problem"), "id", F.col("depends_on").alias("about"))
    gaps = portal.coverage_problems(found, portal.configuration(spark, config)).select(F.col("side").alias("problem"), "id", F.lit(None).cast("string").alias("about"))
    assert not portal.header_problems(found).limit(1).count()
    return lost.unionAll(gaps)


@_register("select page_id, unnest(list_distinct(regexp_extract_all(html || '<h1 id=\"p' || page_id || '\"><p class=\"x\" id=\"end\">', '<[a-zA-Z][^>]*?\\bid\\s*=\\s*\"([^\"]*)\"', 1))) as anchor from pages")
def page_anchors(spark, sf_dir):
    more = F.concat(F.lit('<h1 id="p'), F.col("page_id").cast("string"), F.lit('"><p class="x" id="end">'))
    return pages.anchors(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.concat("html", more).alias("html")))


@_register(
    "select '/' || source || '/' || lang || '/' || doc_id || '.txt' as path_key, doc_id * 1000 + doc_id % 2 as modified_unix_ns, case when doc_id % 2 = 1 then 'batch 1' else 'batch 0' end as analysed_in from documents"
)
def incremental_scan(spark, sf_dir):
    """Two listings of all documents in a stream; in the second every other one has changed, and only those are analysed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    key = F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    path = F.struct(F.lit("utf8").alias("encoding"), key.alias("value"), F.lit(None).cast("string").alias("base64"))
    top = _folder(spark, "stream")
    store = StateStore(spark, f"{top}/state").open()
    numbers = iter(range(10))

    def analyse(rows):
        name = f"batch {next(numbers)}"
        nothing = {"media_kind": "string", "status": "string", "warnings": "array<string>", "media": dict(store.cache().dtypes)["media"], "probe_signature": "string"}
        return rows.select(
            "path_key", "size_bytes", "modified_unix_ns", "filesystem_id", "file_id", "changed_unix_ns", F.lit("h").alias("content_hash"), F.lit("current").alias("evidence_validity"),
            F.lit(name).alias("content_type"), *(F.lit(None).cast(t).alias(c) for c, t in nothing.items()),
        )

    for scan in (0, 1):
        time = F.col("doc_id") * 1000 + (F.col("doc_id") % 2 if scan else F.lit(0))
        size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
        found = docs.select(path.alias("path"), key.alias("path_key"), path_functions.components(key).alias("components"), size.alias("size_bytes"), time.alias("modified_unix_ns"), F.lit(5).cast("long").alias("changed_unix_ns"),
                            F.lit(1).cast("decimal(20,0)").alias("device_id"), F.col("doc_id").cast("decimal(20,0)").alias("inode"), F.lit(1).cast("long").alias("link_count"))
        found.write.mode("append").parquet(f"{top}/listings")
        incremental.follow(incremental.listings(spark, f"{top}/listings"), store, analyse, f"{top}/checkpoint").awaitTermination()
    return store.cache().select("path_key", "modified_unix_ns", F.col("content_type").alias("analysed_in"))


# Path bytes, their display form, and their rank in the order of keys.
_ODD_PATHS = (
    (b"/a", "/a", 3), (b"/r/a.b", "/r/a.b", 4), (b"/r/a/b", "/r/a/b", 5), (b"/tmp/line\n\x1b[31m.txt", None, 6), (b"/data/\x80\x81\x82/media.mkv", None, 1), (b"/tmp/\xff\xfe/file.bin", None, 2),
)


@_register("select * from (values " + ", ".join(f"({i}, {rank}, true, {str(b'\xff' not in raw and b'\x80' not in raw).lower()}, true)" for i, (raw, _, rank) in enumerate(_ODD_PATHS)) + ") t(n, key_rank, round_trip, is_utf8, printable)")
def odd_paths(spark, sf_dir):
    """Paths of any bytes: lossless, ordered by key, and shown without control characters."""
    natives = [path_functions.from_bytes(raw) for raw, *_ in _ODD_PATHS]
    keys = [path_functions.key_of(x) for x in natives]
    order = sorted(keys)
    out = []
    for n, ((raw, shown, _), native, key) in enumerate(zip(_ODD_PATHS, natives, keys)):
        display = path_functions.display(native)
        assert shown is None or display == shown
        out.append((n, order.index(key) + 1, path_functions.to_bytes(native) == raw, native["encoding"] == "utf8", escaped(display) == display and display.isprintable()))
    return _rows(spark, out, "n int, key_rank int, round_trip boolean, is_utf8 boolean, printable boolean")


@_register(
    "with p as (select '/' || page_id || '.html' as path, html from pages), r as (select '/' || page_id || '.html' as path, unnest([url, 'href=\"https://', 'required word']) as copy from pages union all select '/absent.html', 'x') "
    "select r.path, r.copy from r left join p using (path) where p.path is null or not contains(p.html, r.copy)"
)
def required_copy(spark, sf_dir):
    """What pages must say and don't: their own address, a link, a word; and a page that isn't there."""
    path = F.concat(F.lit("/"), F.col("page_id").cast("string"), F.lit(".html"))
    held = spark.read.parquet(f"{sf_dir}/pages.parquet").select(path.alias("path"), "html", "url")
    asked = held.select("path", F.explode(F.array("url", F.lit('href="https://'), F.lit("required word"))).alias("copy"))
    asked = asked.unionAll(spark.createDataFrame([("/absent.html", "x")], "path string, copy string"))
    return pages.missing_copy(held, asked)


@_register(
    "select v as version, 5 as migrated, (select count(*) from documents) as kept, case when v = 5 then (select count(*) from documents) else 0 end as hits, (select count(*) from documents) as after "
    "from (select unnest([1, 2, 3, 4, 5]) as v)"
)
def state_migrations(spark, sf_dir):
    """A cache written in each older layout: it opens, its rows stay, those without a whole signature are no hits, and new ones take their places."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    nothing = {"content_type": "string", "media_kind": "string", "status": "string", "warnings": "array<string>", "probe_signature": "string"}
    out = []
    for version, _ in MIGRATIONS:
        store = StateStore(spark, _folder(spark, f"state-{version}"))
        store.open()
        rows = docs.select(
            F.concat(F.lit("/"), F.col("doc_id").cast("string")).alias("path_key"), F.lit(3).cast("long").alias("size_bytes"), F.lit(7).cast("long").alias("modified_unix_ns"), F.lit("h").alias("content_hash"),
            F.lit("d").alias("filesystem_id"), F.col("doc_id").cast("string").alias("file_id"), F.lit("current").alias("evidence_validity"), F.lit(9).cast("long").alias("changed_unix_ns"),
            F.lit(None).cast(dict(store.cache().dtypes)["media"]).alias("media"), *(F.lit(None).cast(t).alias(c) for c, t in nothing.items()),
        )
        held = [c for number, ddl in MIGRATIONS for c in column_names(ddl) if number <= version]
        rows.select(*held).write.parquet(store._at("cache", "old"))
        with open(store._at("cache", "CURRENT"), "w") as f:
            f.write("old")
        with open(store._at("version.json"), "w") as f:
            json.dump({"version": version}, f)
        store.open()
        kept = store.cache().count()
        hits = cache.lookup(rows.select("path_key", *cache.SIGNATURE), store.cache().select("path_key", *cache.SIGNATURE, "content_hash")).where("cache_hit").count()
        store.remember(rows)
        out.append((version, store.version(), kept, hits, store.cache().count()))
    return _rows(spark, out, "version int, migrated int, kept long, hits long, after long")


@_register("select doc_id, doc_id % 2 = 0 and coalesce(octet_length(encode(text)), 0) > 0 as hit from documents")
def cache_by_state_store(spark, sf_dir):
    """The stored cache after an upsert: a signature that has changed, or lacks its identity, isn't a hit."""
    store = StateStore(spark, _folder(spark, "state")).open()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    nothing = {"content_type": "string", "media_kind": "string", "status": "string", "warnings": "array<string>", "media": dict(store.cache().dtypes)["media"], "probe_signature": "string"}
    seen = docs.select(
        "doc_id", F.concat(F.lit("/"), F.col("doc_id").cast("string")).alias("path_key"), size.alias("size_bytes"), F.lit(7).cast("long").alias("modified_unix_ns"), F.lit("d").alias("filesystem_id"),
        F.when(size > 0, F.col("doc_id").cast("string")).alias("file_id"), F.lit(9).cast("long").alias("changed_unix_ns"), F.lit("h").alias("content_hash"), F.lit("current").alias("evidence_validity"),
        *(F.lit(None).cast(t).alias(c) for c, t in nothing.items()),
    )
    store.remember(seen)
    again = seen.select("doc_id", "path_key", *cache.SIGNATURE).withColumn("modified_unix_ns", F.col("modified_unix_ns") + F.col("doc_id") % 2)
    return cache.lookup(again, store.cache().select("path_key", *cache.SIGNATURE, "content_hash")).select("doc_id", F.col("cache_hit").alias("hit"))


@_register(_FILES_SQL + "select path, size_bytes, true as same_by_handle, false as bare_identity, 0 as warnings from files union all select '/absent', 7, true, false, 1")
def file_metadata(spark, sf_dir):
    """Allocation and identity by path and by open file; a path that isn't there is a warning."""
    root, found = _scanned(spark, sf_dir)

    def one(path: str, size: int) -> dict:
        raw = path.encode()
        got = filesystem.allocation_of_path(raw, size)
        same, bare = True, None
        if got["identity"]:
            fd = os.open(raw, os.O_RDONLY)
            try:
                handle = filesystem.metadata_of_file(fd)
            finally:
                os.close(fd)
            same = all(handle[k] == v for k, v in (got["allocation"] | got["identity"]).items() if k != "platform")
            bare = filesystem.bare_signature(os.lstat(raw))["file_id"]
        return {"path": path, "size_bytes": got["allocation"]["logical_size_bytes"], "same_by_handle": same, "bare_identity": bare is not None, "warnings": len(got["warnings"])}

    def work(batches):
        schema = pa.schema([("path", pa.string()), ("size_bytes", pa.int64()), ("same_by_handle", pa.bool_()), ("bare_identity", pa.bool_()), ("warnings", pa.int32())])
        for batch in batches:
            yield pa.RecordBatch.from_pylist([one(p, n) for p, n in zip(*(batch.column(c).to_pylist() for c in ("path_key", "size_bytes")))], schema=schema)

    asked = found.files.select("path_key", "size_bytes").unionAll(spark.createDataFrame([(f"{root}/absent", 7)], "path_key string, size_bytes long"))
    return asked.mapInArrow(work, "path string, size_bytes long, same_by_handle boolean, bare_identity boolean, warnings int").withColumn("path", _relative(root, "path"))


@_register(
    "select * from (values ('handle', 12, 'video', null, true), ('path', 12, 'video', null, true), ('link', null, null, 'refused', false), ('status', null, 'tool 1.0', null, true), ('no tool', null, null, 'absent', false)) t(how, bit_rate, told, problem, found)"
)
def media_probes(spark, sf_dir):
    """A probe through an open file, by path and by link, and where the tool is; a script stands for the tool."""
    top = _folder(spark, "probe")
    with open(f"{top}/ffprobe", "w") as f:
        f.write('#!/bin/sh\nif [ "$1" = "-version" ]; then echo "tool 1.0"; exit; fi\necho \'{"format": {"bit_rate": "12"}, "streams": [{"codec_type": "video", "sample_rate": "odd"}]}\'\n')
    os.chmod(f"{top}/ffprobe", 0o755)
    with open(f"{top}/file", "w") as f:
        f.write("x")
    os.symlink(f"{top}/file", f"{top}/link")
    before, runner, out = os.environ.get("PATH", ""), processes.Runner(), []
    os.environ["PATH"] = f"{top}:{before}"
    try:
        with open(f"{top}/file", "rb") as f:
            got = processes.probe(f.fileno(), runner)
        out.append(("handle", got["bit_rate"], got["streams"][0]["codec_type"], None, got["streams"][0]["sample_rate"] is None))
        got = processes.probe_path(f"{top}/file".encode(), runner)
        out.append(("path", got["bit_rate"], got["streams"][0]["codec_type"], None, got["streams"][0]["sample_rate"] is None))
        try:
            processes.probe_path(f"{top}/link".encode(), runner)
        except OSError:
            out.append(("link", None, None, "refused", False))
        status = processes.tool_status("ffprobe", "media metadata")
        out.append(("status", None, status["version"], None, status["available"]))
        status = processes.tool_status("no-such-tool", "nothing")
        out.append(("no tool", None, status["version"], None if status["available"] else "absent", status["available"]))
    finally:
        os.environ["PATH"] = before
    return _rows(spark, out, "how string, bit_rate int, told string, problem string, found boolean")


_RACES = ("replace", "truncate", "grow", "chmod", "link", "remove")


@_register(
    "select change, stage, false as is_current, false as has_hash, case when change = 'none' then 1 else 2 end as attempts from (select unnest(['replace', 'truncate', 'grow', 'chmod', 'link', 'remove']) as change), "
    "(select unnest(['after_open', 'after_evidence']) as stage) union all select 'none', 'after_open', true, true, 1 union all select 'before', 'after_open', true, true, 2"
)
def observation_races(spark, sf_dir):
    """A file that changes while it is read, at every attempt, never gives current evidence; one that changed before does at the second."""
    top, out = _folder(spark, "races"), []

    def changed(change: str, path: str) -> None:
        if change == "replace":
            with open(f"{path}.new", "wb") as f:
                f.write(b"content")
            os.replace(f"{path}.new", path)
        elif change == "truncate":
            os.truncate(path, max(0, os.path.getsize(path) - 1))
        elif change == "grow":
            with open(path, "ab") as f:
                f.write(b"more")
        elif change == "chmod":
            os.chmod(path, os.stat(path).st_mode ^ 0o040)
        elif change == "link":
            os.link(path, f"{path}.{publish.uuid7()}")
        elif change == "remove" and os.path.exists(path):
            os.rename(path, f"{path}.gone")
            with open(path, "wb") as f:
                f.write(b"another")

    for change in (*_RACES, "none", "before"):
        for stage in ("after_open", "after_evidence") if change in _RACES else ("after_open",):
            path = f"{top}/{change}-{stage}"
            with open(path, "wb") as f:
                f.write(b"content")
            row = filesystem.file_row(path.encode(), os.lstat(path)) | {"needs_hash": True, "cache_hit": False}
            if change == "before":
                changed("grow", path)

            def hook(at, _path, change=change, stage=stage, path=path):
                if at == stage:
                    changed(change, path)

            got = observe.observe_file(row, filesystem.ScanOptions(probe_media=False), hook=hook)
            out.append((change, stage, got["evidence_validity"] == "current", got["content_hash"] is not None, got["attempt_count"]))
    return _rows(spark, out, "change string, stage string, is_current boolean, has_hash boolean, attempts int")


@_register("select * from (values ('success', 'c: success', ''), ('partial', 'c: partial success, coverage partial', ''), ('escaped', 'c: invalid input', 'error: bad\\x1b[31m (2 times)')) t(name, first_line, errors)")
def command_text(spark, sf_dir):
    """What a person reads: one line for the outcome, diagnostics with their counts, nothing that acts on a terminal."""
    cases = (("success", {}), ("partial", {"coverage": "partial", "result": {"summary": {"file_count": 1}}}), ("escaped", {"diagnostics": [blocking("a", "input", "bad\x1b[31m")] * 2}))
    out = []
    for name, told in cases:
        text, errors = human(CommandResult.resolve("c", **told))
        out.append((name, text.splitlines()[0], errors.strip()))
    return _rows(spark, out, "name string, first_line string, errors string")


@_register(
    "select * from (values ('config', 'whole', true), ('config', 'unknown key', false), ('config', 'odd value', false), ('command_result', 'whole', true), ('command_result', 'success with code 2', false), "
    "('command_result', 'failure with code 0', false), ('effective_policy', 'whole', true), ('effective_policy', 'without fingerprints', false)) t(contract, document, valid)"
)
def contract_checks(spark, sf_dir):
    config = {"schema": policy.CONFIG_SCHEMA, "scan": {"probe_media": True}}
    result = CommandResult.resolve("c").as_dict()
    whole = policy.resolve(no_config=True, environment={"HOME": "/"}).policy
    cases = (
        ("config", "whole", config), ("config", "unknown key", config | {"more": 1}), ("config", "odd value", config | {"output": {"format": "xml"}}), ("command_result", "whole", result),
        ("command_result", "success with code 2", result | {"exit_code": 2}), ("command_result", "failure with code 0", result | {"outcome": "internal_failure"}), ("effective_policy", "whole", whole),
        ("effective_policy", "without fingerprints", {k: v for k, v in whole.items() if k != "fingerprints"}),
    )
    return _rows(spark, [(contract, name, not list(problems(SCHEMAS[contract], document))) for contract, name, document in cases], "contract string, document string, valid boolean")


@_register(
    "with b as (select doc_id, encode(coalesce(text, '')) as raw from documents) select doc_id, case doc_id % 4 when 0 then 'image/png' when 1 then 'application/pdf' when 2 then 'video/mp4' end as content_type, "
    "case doc_id % 4 when 0 then 'image' when 1 then 'other' when 2 then 'video' else 'unknown' end as media_kind, case when doc_id % 2 = 0 then 'analyzed' else 'unsupported' end as status from b"
)
def media_sniffing(spark, sf_dir):
    """Texts behind the first bytes of a format, and behind none."""
    n = F.col("doc_id") % 4
    mark = F.when(n == 0, F.lit(b"\x89PNG\r\n\x1a\n")).when(n == 1, F.lit(b"%PDF")).when(n == 2, F.lit(b"\0\0\0\x18ftypisom")).otherwise(F.lit(b"plain "))
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.concat(mark, F.coalesce("text", F.lit("")).cast("binary")).alias("raw"))
    kinds = rows.select("doc_id", media.sniffed(F.col("raw")).alias("content_type"))
    kinds = kinds.withColumn("media_kind", media.media_kind(F.col("content_type")))
    return kinds.withColumn("status", media.status(F.col("media_kind")))


@_register("select * from (values ('time', true), ('unique', true), ('ordered', true), ('version', true), ('variant', true)) t(property, holds)")
def run_identifiers(spark, sf_dir):
    """Identifiers that sort by time, and times with their zone."""
    import datetime
    import time
    import uuid

    made = []
    for _ in range(20):
        made.append(uuid.UUID(publish.uuid7()))
        time.sleep(0.002)
    told = datetime.datetime.fromisoformat(publish.now())
    near = told.tzinfo is not None and abs((datetime.datetime.now(datetime.UTC) - told).total_seconds()) < 60
    out = [("time", near), ("unique", len(set(made)) == 20), ("ordered", made == sorted(made)), ("version", {x.version for x in made} == {7}), ("variant", {x.variant for x in made} == {uuid.RFC_4122})]
    return _rows(spark, out, "property string, holds boolean")


# Published BLAKE3 test vectors, of bytes 0..250 repeated, by length.
_VECTORS = (
    (0, "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"), (1, "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213"), (1024, "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7"),
    (1025, "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444"), (3072, "b98cb0ff3623be03326b373de6b9095218513e64f1ee2edd2525c7ad1e5cffd2"), (31744, "62b6960e1a44bcc1eb1a611a8d6235b6b4b78f32e7abc4fb4c6cdcce94895c47"),
)


@_register("select * from (values " + ", ".join(f"({n}, '{digest}', true)" for n, digest in _VECTORS) + ") t(n, digest, same_in_pieces)")
def blake3_digests(spark, sf_dir):
    """True BLAKE3 in a column, and in pieces as files are read."""
    messages = [(n, bytes(i % 251 for i in range(n))) for n, _ in _VECTORS]
    rows = spark.createDataFrame(messages, "n int, raw binary").select("n", blake3.blake3_udf()("raw").alias("digest"))
    pieces = []
    for n, message in messages:
        whole = blake3.Hasher()
        for at in range(0, n, 700):
            whole.update(message[at : at + 700])
        pieces.append((n, whole.hexdigest()))
    return rows.join(spark.createDataFrame(pieces, "n int, in_pieces string"), "n").select("n", "digest", (F.col("digest") == F.col("in_pieces")).alias("same_in_pieces"))


@_register("select * from (values ('none', null), ('self', '1 nodes depend on each other'), ('pair', '2 nodes depend on each other'), ('behind a cycle', '3 nodes depend on each other')) t(name, problem)")
def dependency_cycles(spark, sf_dir):
    cases = (("none", [("b", "a"), ("c", "b")]), ("self", [("b", "a"), ("c", "c")]), ("pair", [("b", "c"), ("c", "b")]), ("behind a cycle", [("a", "b"), ("b", "c"), ("c", "b")]))
    nodes, out = spark.createDataFrame([("a",), ("b",), ("c",)], "id string"), []
    for name, edges in cases:
        try:
            graph.dag_rank(nodes, spark.createDataFrame(edges, "id string, depends_on string"))
            out.append((name, None))
        except graph.CycleError as error:
            out.append((name, str(error)))
    return _rows(spark, out, "name string, problem string")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
