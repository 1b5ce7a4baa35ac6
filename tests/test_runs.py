import json
import os
import shutil
import signal
import subprocess
import sys

import pytest

from sedimark import cli
from sedimark.functions import blake3
from sedimark.operators import cache, diagnostics, graph
from sedimark.runs import policy, publish
from sedimark.runs.contracts import ContractError, problems, validate
from sedimark.runs.engine import Engine, Signals
from sedimark.runs.outcome import CommandResult, Diagnostic, Refused, blocking, coalesced, human
from sedimark.runs.state import StateStore
from sedimark.sources import filesystem, observe, processes


@pytest.fixture
def collection(tmp_path):
    folder = tmp_path / "media with spaces"
    folder.mkdir()
    (folder / "first-🌌.bin").write_bytes(b"identical fixture bytes")
    (folder / "second.bin").write_bytes(b"identical fixture bytes")
    (folder / "unique.bin").write_bytes(b"different fixture")
    return folder


@pytest.fixture
def engine(spark, tmp_path):
    line = {"operational_policy.state_directory": str(tmp_path / "state")}
    return Engine(spark, policy.resolve(line, no_config=True, environment={"HOME": str(tmp_path)}), Signals())


# --- end to end


def test_scan_plan_report(engine, collection, tmp_path):
    before = {p.name: (p.read_bytes(), p.stat().st_mtime_ns) for p in collection.iterdir()}
    scan = engine.scan([str(collection)])
    assert (scan.outcome, scan.exit_code, scan.coverage) == ("success", 0, "complete")
    assert scan.result["summary"]["exact_duplicate_groups"] == 1 and scan.result["summary"]["reclaimable_bytes"] == 23
    assert [a["kind"] for a in scan.artifacts] == ["effective_policy", "run", "report", "artifact_set"]
    run = scan.result["run"]["run_id"]
    plan = engine.plan(run, str(tmp_path / "plan.json"))
    assert plan.result["summary"] == {"action_count": 1, "candidate_file_count": 1, "potential_reclaimable_bytes": 23}
    assert len(plan.result["actions"][0]["preconditions"]) == 2 and not plan.result["safety"]["mutates_files"]
    assert publish.inspect_plan(str(tmp_path / "plan.json")).status == "committed"
    assert engine.report(run).result["summary"] == scan.result["summary"]
    assert engine.scan([str(collection)]).result["summary"]["cache_hits"] == 3
    assert engine.cache_status().result["completed_runs"] == 2
    assert before == {p.name: (p.read_bytes(), p.stat().st_mtime_ns) for p in collection.iterdir()}
    stored = engine._store().table("duplicate_groups")
    assert stored.count() == 2


def test_partial_and_invalid_inputs(engine, collection, tmp_path):
    partial = engine.scan([str(collection), str(tmp_path / "missing")])
    assert (partial.outcome, partial.exit_code, len(partial.artifacts)) == ("partial_success", 3, 4)
    shutil.rmtree(tmp_path / "state")
    none = engine.scan([str(tmp_path / "missing")])
    assert (none.exit_code, none.artifacts) == (2, []) and not (tmp_path / "state").exists()


def test_every_issue_is_a_diagnostic(engine, collection, tmp_path):
    missing = [str(tmp_path / f"missing-{i}") for i in range(10_050)]
    scan = engine.scan([str(collection), *missing])
    told = {d["context"]["path"] for d in scan.diagnostics if d["code"] == "partial_inventory"}
    assert told == set(missing) and scan.outcome == "partial_success"
    assert engine._store().table("diagnostics").count() == len(missing)


def test_a_crash_after_publication_is_recovered(engine, collection):
    class Crash(BaseException):
        pass

    def hook(stage):
        if stage == "published":
            raise Crash

    with pytest.raises(Crash):
        engine.scan([str(collection)], hook)
    store = StateStore(engine.spark, engine.state_directory)
    (row,) = store.runs()
    assert row["status"] == "running"
    assert engine.report(row["run_id"]).outcome == "success"
    assert store.status(row["run_id"]) == "completed"
    (group,) = store.table("duplicate_groups", row["run_id"]).collect()
    assert (group.member_count, group.size_bytes) == (2, 23) and store.table("plan_paths").count() == 2 and store.table("observed").count() == 3


@pytest.mark.parametrize("gone", ["run", "report"])
def test_a_set_of_another_run_is_not_recovered(engine, collection, gone):
    class Crash(BaseException):
        pass

    def hook(stage):
        if stage == "published":
            raise Crash

    with pytest.raises(Crash):
        engine.scan([str(collection)], hook)
    store = StateStore(engine.spark, engine.state_directory)
    (row,) = store.runs()
    # another set's document with a marker that fits it byte by byte
    folder = store.run_folder(row["run_id"])
    document = json.load(open(f"{folder}/{gone}.json"))
    (document if gone == "run" else document["run"])["run_id"] = publish.uuid7()
    content = publish.json_bytes(document)
    open(f"{folder}/{gone}.json", "wb").write(content)
    marker = json.load(open(f"{folder}/{publish.MARKER}"))
    for m in marker["members"]:
        if m["kind"] == gone:
            m["size_bytes"], m["digest"]["value"] = len(content), blake3.hash_one(content)
    open(f"{folder}/{publish.MARKER}", "wb").write(publish.json_bytes(marker))
    assert engine.report(row["run_id"]).exit_code == 5 and store.status(row["run_id"]) == "running"


def test_a_run_ends_once(engine):
    store = engine._store()
    store.begin("r", publish.now())
    other = StateStore(engine.spark, engine.state_directory)
    assert store.mark("r", "interrupted") and not other.mark("r", "failed") and other.status("r") == "interrupted"
    # both saw it running: the link decides
    store.begin("s", publish.now())
    seen = store.run("s")
    assert other.mark("s", "failed")
    store.run = lambda run_id: seen
    assert not store.mark("s", "completed") and other.status("s") == "failed"
    assert [r["run_id"] for r in other.runs()] == ["r", "s"]


@pytest.mark.parametrize("change", ["grow", "appear", "vanish"])
def test_no_file_is_lost_between_walk_and_observation(engine, collection, change):
    def hook(stage):
        if stage != "discovered":
            return
        if change == "grow":
            (collection / "unique.bin").write_bytes(b"now as long as the others"[:23])
        elif change == "appear":
            (collection / "later.bin").write_bytes(b"different fixture")
        else:
            (collection / "second.bin").unlink()

    scan = engine.scan([str(collection)], hook)
    names = {o["path"]["value"].rpartition("/")[2]: o["evidence_validity"] for o in scan.result["observations"]}
    assert set(names) == {"first-🌌.bin", "second.bin", "unique.bin"}
    assert names["second.bin"] == ("unavailable" if change == "vanish" else "current")


def test_large_trees_are_split(tmp_path):
    for i in range(12):
        (tmp_path / f"r/{i}/deep/er").mkdir(parents=True)
        (tmp_path / f"r/{i}/deep/er/f").write_text("x")
        (tmp_path / f"r/{i}/g").write_text("x")
    (tmp_path / "r/top").write_text("x")
    root, options = os.fsencode(tmp_path / "r"), filesystem.ScanOptions()
    whole = sorted(row["path_key"] for _, row in filesystem.walk(root, options))
    for wanted in (1, 2, 10, 20, 1000):
        walks = filesystem.split_walks([root], options, wanted=wanted)
        assert sorted(row["path_key"] for w in walks for _, row in filesystem.walk(w, options)) == whole and len(whole) == 25
        assert len(walks) >= min(wanted, 37)


def test_walks_and_hashes_stop_when_told(tmp_path):
    for i in range(5):
        (tmp_path / f"r/{i}").mkdir(parents=True)
        (tmp_path / f"r/{i}/f").write_bytes(b"x" * 10)
    stop, seen = tmp_path / "stop", []
    for _, row in filesystem.walk(os.fsencode(tmp_path / "r"), filesystem.ScanOptions(), cancelled=filesystem.stopped_by(str(stop))):
        seen.append(row)
        stop.touch()
    assert len(seen) == 1
    with pytest.raises(observe.Cancelled):
        observe.observe_file(discovered(tmp_path / "r/1/f"), filesystem.ScanOptions(), cancelled=filesystem.stopped_by(str(stop)))


def test_metadata_by_path(tmp_path):
    (tmp_path / "f").write_bytes(b"x" * 5000)
    got = filesystem.allocation_of_path(os.fsencode(tmp_path / "f"), 5000)
    assert got["allocation"]["allocated_size_bytes"] >= 512 and got["identity"]["link_count"] == 1 and got["warnings"] == []
    lost = filesystem.allocation_of_path(os.fsencode(tmp_path / "gone"), 7)
    assert (lost["allocation"]["logical_size_bytes"], lost["allocation"]["allocation_source"], lost["identity"], len(lost["warnings"])) == (7, "unavailable", None, 1)
    bare = filesystem.bare_signature(os.lstat(tmp_path / "f"))
    assert bare["size_bytes"] == 5000 and bare["file_id"] is None and bare["changed_unix_ns"] is None


def test_a_signal_interrupts(engine, collection):
    def hook(stage):
        if stage == "begun":
            engine.signals.caught = signal.SIGINT

    stopped = engine.scan([str(collection)], hook)
    assert (stopped.outcome, stopped.exit_code) == ("interrupted", 130)
    run = stopped.diagnostics[0]["context"]["run_id"]
    engine.signals.caught = None
    refused = engine.report(run)
    assert (refused.exit_code, refused.diagnostics[0]["code"]) == (5, "source_run_interrupted")


def test_older_reports_and_broken_sets(engine, collection, tmp_path):
    scan = engine.scan([str(collection)])
    folder = scan.result["run"]["artifact_directory"]
    report = json.loads(open(f"{folder}/report.json").read())
    for version in (1, 2, 4):
        old = report | {"schema": f"sedimark.report.v{version}"}
        old = {k: v for k, v in old.items() if k not in ("hard_link_groups", "storage")}
        for o in old["observations"]:
            o.pop("observation_stability", None)
        path = tmp_path / f"v{version}.json"
        path.write_text(json.dumps(old))
        assert engine.plan(str(path), str(tmp_path / f"plan{version}.json")).exit_code == 0
    (tmp_path / "odd.json").write_text('{"schema": "other"}')
    assert engine.report(str(tmp_path / "odd.json")).exit_code == 5
    os.unlink(f"{folder}/run.json")
    assert engine.report(scan.result["run"]["run_id"]).diagnostics[0]["code"] == "artifact_set_incomplete"


# --- filesystem


def test_walk_rules(spark, tmp_path):
    (tmp_path / "r/.hid").mkdir(parents=True)
    (tmp_path / "r/.hid/x").write_text("x")
    (tmp_path / "r/_under").write_text("x")
    (tmp_path / "r/a").mkdir()
    (tmp_path / "r/a/b").write_text("x")
    (tmp_path / "r/a.b").write_text("x")
    os.symlink(tmp_path / "r/a", tmp_path / "r/link")
    os.symlink(tmp_path / "r/a.b", tmp_path / "r/file-link")
    os.symlink(tmp_path / "r", tmp_path / "r/a/loop")
    root = str(tmp_path / "r")

    def names(options=None, roots=(root,), state=None):
        found = filesystem.discover(spark, list(roots), options or filesystem.ScanOptions(), state)
        files = sorted(r.path_key.removeprefix(root) for r in found.files.collect())
        return files, sorted(i.kind for i in found.issues.collect()), found.accepted

    assert names() == (["/_under", "/a.b", "/a/b"], [], 1)
    assert names(roots=(root, root, f"{root}/a", f"{root}/./a")) == (["/_under", "/a.b", "/a/b"], [], 3)
    assert names(filesystem.ScanOptions(include_hidden=True))[0] == ["/.hid/x", "/_under", "/a.b", "/a/b"]
    files, issues, _ = names(filesystem.ScanOptions(follow_symlinks=True))
    assert files == ["/_under", "/a.b", "/a/b", "/link/b"] and "path_changed" in issues and "traversal_incomplete" in issues
    assert names(roots=(f"{root}/link",)) == ([], ["input_excluded_by_policy"], 0)
    assert names(filesystem.ScanOptions(follow_symlinks=True), (f"{root}/link",))[1] == ["invalid_input_type"]
    assert names(state=f"{root}/a")[0] == ["/_under", "/a.b"]
    assert names(roots=(f"{root}/.hid", f"{root}/.hid/x"))[0] == ["/.hid/x"]


def discovered(path, **more):
    return filesystem.file_row(os.fsencode(path), os.lstat(path)) | {"needs_hash": True, "cache_hit": False} | more


@pytest.mark.parametrize("change", ["replace", "truncate", "grow", "chmod", "link", "remove"])
@pytest.mark.parametrize("stage", ["after_open", "after_evidence"])
def test_races_never_give_current_evidence(tmp_path, change, stage):
    path = tmp_path / "f"
    path.write_bytes(b"content")
    row = discovered(path)

    def hook(at, _path):
        if at != stage:
            return
        if change == "replace":
            (tmp_path / "g").write_bytes(b"content")
            os.replace(tmp_path / "g", path)
        elif change == "truncate":
            path.write_bytes(b"x")
        elif change == "grow":
            with path.open("ab") as f:
                f.write(b"more")
        elif change == "chmod":
            path.chmod(0o600 if path.stat().st_mode & 0o077 else 0o644)
        elif change == "link":
            os.link(path, tmp_path / f"l{len(list(tmp_path.iterdir()))}")
        elif path.exists():
            path.unlink()

    got = observe.observe_file(row, filesystem.ScanOptions(), hook=hook)
    assert got["evidence_validity"] != "current" and got["content_hash"] is None and got["observation_stability"] != "stable"


def test_hashes_by_path(tmp_path):
    path = tmp_path / "f"
    path.write_bytes(b"content")
    raw = os.fsencode(path)
    digest, kind = observe.hash_path(raw)
    assert (digest, kind) == (blake3.hash_one(b"content"), "stable")
    assert observe.has_content(raw, 7, digest) and not observe.has_content(raw, 8, digest) and not observe.has_content(raw, 7, "0" * 64)
    assert observe.hash_path(raw, hook=lambda stage, p: path.write_bytes(b"other size"))[0] is None
    os.symlink(path, tmp_path / "l")
    assert observe.hash_path(os.fsencode(tmp_path / "l")) == (None, "became_symlink")
    assert observe.hash_path(os.fsencode(tmp_path / "gone")) == (None, "disappeared_during_scan")


def test_probes_by_path(tmp_path, monkeypatch):
    """A tool that echoes JSON stands for the probe; a link isn't followed."""
    (tmp_path / "tool").write_text('#!/bin/sh\necho \'{"format": {"format_name": "x", "bit_rate": "12"}, "streams": [{"index": 0, "sample_rate": "odd"}]}\'\n')
    (tmp_path / "tool").chmod(0o755)
    (tmp_path / "f").write_bytes(b"x")
    monkeypatch.setattr(processes, "PROBE", (str(tmp_path / "tool"),))
    got = processes.probe_path(os.fsencode(tmp_path / "f"), processes.Runner())
    assert got["bit_rate"] == 12 and got["streams"][0]["sample_rate"] is None
    os.symlink(tmp_path / "f", tmp_path / "l")
    with pytest.raises(OSError):
        processes.probe_path(os.fsencode(tmp_path / "l"), processes.Runner())
    monkeypatch.setattr(os.path, "exists", lambda path: False)
    with pytest.raises(processes.ToolError) as error:
        processes.probe_path(os.fsencode(tmp_path / "f"), processes.Runner())
    assert error.value.kind == "start_failed"


def test_a_change_before_reading_is_observed_anew(tmp_path):
    path = tmp_path / "f"
    path.write_bytes(b"old")
    row = discovered(path)
    path.write_bytes(b"newer")
    got = observe.observe_file(row, filesystem.ScanOptions())
    assert (got["evidence_validity"], got["attempt_count"], got["size_bytes"]) == ("current", 2, 5)


def test_a_link_put_in_place_of_a_file(tmp_path):
    path = tmp_path / "f"
    path.write_bytes(b"old")
    row = discovered(path)
    path.unlink()
    os.symlink("/etc/hostname", path)
    assert observe.observe_file(row, filesystem.ScanOptions())["observation_stability"] == "became_symlink"


# --- tools


def test_tool_limits():
    runner = processes.Runner(processes.Limits(timeout=0.5, stdout=10))
    assert runner.run(["sh", "-c", "printf 123456789012345"]).stdout_truncated
    for kind, command in (("timeout", ["sleep", "5"]), ("not_found", ["no-such-tool"]), ("exit_status", ["false"]), ("invalid_json", ["echo", "x"])):
        with pytest.raises(processes.ToolError) as error:
            runner.run_json(command)
        assert error.value.kind == kind
    with pytest.raises(processes.ToolError) as error:
        runner.run(["sleep", "5"], cancelled=lambda: True)
    assert error.value.kind == "cancelled"
    assert processes.Runner().run_json(["cat"], stdin=_json_file()) == {"a": 1}


def _json_file():
    import tempfile

    f = tempfile.TemporaryFile()
    f.write(b'{"a": 1}')
    f.seek(0)
    return f


# --- publication


def payloads():
    return [publish.Payload.of("effective_policy", "p", "effective-policy.json", {"schema": "p"}), publish.Payload.of("run", "r", "run.json", {"schema": "r"}), publish.Payload.of("report", "t", "report.json", {"schema": "t"})]


def test_a_fault_before_publication_leaves_nothing(tmp_path):
    def fail(stage):
        if stage == "staged":
            raise OSError("disk full")

    with pytest.raises(OSError):
        publish.commit_scan(str(tmp_path / "set"), "run", "set", payloads(), fail)
    assert list(tmp_path.iterdir()) == []
    publish.commit_scan(str(tmp_path / "set"), "run", "set", payloads())
    assert publish.inspect_scan(str(tmp_path / "set")).status == "committed"
    with pytest.raises(FileExistsError):
        publish.commit_scan(str(tmp_path / "set"), "run", "set", payloads())
    (tmp_path / "set/run.json").write_text("{}")
    assert publish.inspect_scan(str(tmp_path / "set")).status == "incomplete"
    (tmp_path / "set" / publish.MARKER).write_text('{"schema": "x"}')
    assert publish.inspect_scan(str(tmp_path / "set")).status == "incompatible"


def test_a_plan_is_finished_after_a_crash(tmp_path):
    class Crash(BaseException):
        pass

    def crash(stage):
        if stage == "published":
            raise Crash

    path = str(tmp_path / "plan.json")
    plan = publish.Payload.of("plan", "p", "plan.json", {"schema": "p"})
    with pytest.raises(Crash):
        publish.commit_plan(path, "run", None, plan, crash)
    assert publish.inspect_plan(path).status == "incomplete"
    assert publish.recover_plan(path).status == "committed"
    with pytest.raises(FileExistsError):
        publish.commit_plan(path, "run", None, plan)


def test_member_kinds_are_a_set(tmp_path):
    with pytest.raises(ContractError):
        publish.commit_scan(str(tmp_path / "s"), "r", "s", payloads()[:2])


def test_contracts():
    good = {"schema": "sedimark.config.v1", "scan": {"probe_media": True}}
    validate("config", good)
    for bad in ({}, good | {"more": 1}, good | {"scan": {"probe_media": 1}}, good | {"output": {"format": "xml"}}):
        with pytest.raises(ContractError):
            validate("config", bad)
    assert list(problems({"oneOf": [{"type": "string"}, {"minLength": 1}]}, "x"))
    assert not list(problems({"if": {"type": "string"}, "then": {"minLength": 2}}, "xx"))
    assert list(problems({"$ref": "#/d/n", "d": {"n": {"type": "integer", "minimum": 3}}}, 2))


# --- policy


def test_precedence_and_shadows(tmp_path):
    home, work = tmp_path / "home", tmp_path / "work/inner"
    (home / ".config/sedimark").mkdir(parents=True)
    work.mkdir(parents=True)
    text = 'schema = "sedimark.config.v1"\n[state]\ndirectory = "{}"\n'
    (home / ".config/sedimark/config.toml").write_text(text.format("user"))
    (tmp_path / "work/sedimark.toml").write_text(text.format("project"))
    environment = {"HOME": str(home), "SEDIMARK_STATE_DIRECTORY": "env"}
    got = policy.resolve({"state.directory": "line"}, environment=environment, folder=str(work))
    name = "operational_policy.state_directory"
    assert got.values[name] == str(work / "line") and [s["source"] for s in got.shadowed if s["setting"] == name] == ["default", "user_config", "project_config", "environment"]
    assert got.explain("state.directory")["value"] == str(work / "line")
    quiet = policy.resolve(no_config=True, environment=environment, folder=str(work))
    assert quiet.provenance[name]["source"] == "environment"
    explicit = policy.resolve(config=str(tmp_path / "work/sedimark.toml"), environment={"HOME": str(home)}, folder=str(work))
    assert explicit.provenance[name]["source"] == "explicit_config" and {s["status"] for s in explicit.sources} == {"loaded", "suppressed"}


@pytest.mark.parametrize(
    "body, code",
    [
        ("[scan", "configuration_parse_failed"),
        ("x = 1", "configuration_schema_missing"),
        ('schema = "other"', "configuration_schema_unsupported"),
        ('schema = "sedimark.config.v1"\nmore = 1', "configuration_unknown_key"),
        ('schema = "sedimark.config.v1"\n[scan]\nprobe_media = "yes"', "configuration_value_invalid"),
        ('schema = "sedimark.config.v1"\n[output]\nformat = "xml"', "configuration_value_invalid"),
    ],
)
def test_bad_configuration(tmp_path, body, code):
    (tmp_path / "c.toml").write_text(body)
    with pytest.raises(Refused) as refused:
        policy.resolve(config=str(tmp_path / "c.toml"), environment={"HOME": str(tmp_path)})
    assert refused.value.diagnostic.code == code


def test_refused_selections(tmp_path):
    for kwargs, code in (
        ({"config": "a", "no_config": True}, "configuration_selector_conflict"),
        ({"config": "absent.toml"}, "configuration_not_found"),
        ({"environment": {"SEDIMARK_PROBE_MEDIA": "1"}}, "configuration_environment_invalid"),
        ({"command_line": {"no.such": 1}}, "configuration_setting_unknown"),
    ):
        with pytest.raises(Refused) as refused:
            policy.resolve(**({"environment": {"HOME": str(tmp_path)}, "folder": str(tmp_path)} | kwargs))
        assert refused.value.diagnostic.code == code


def test_fingerprints(tmp_path):
    one, two = (policy.resolve(line, no_config=True, environment={"HOME": str(tmp_path)}).policy for line in ({}, {"output.format": "json"}))
    assert one["fingerprints"]["evidence_policy"] == two["fingerprints"]["evidence_policy"]
    assert one["fingerprints"]["effective_configuration"] != two["fingerprints"]["effective_configuration"]
    policy.verify_fingerprints(one)
    with pytest.raises(Refused):
        policy.verify_fingerprints(one | {"evidence_policy": one["evidence_policy"] | {"include_hidden": True}})


# --- outcomes


def test_coalescing_and_precedence():
    twice = [blocking("a", "input", "m"), blocking("a", "input", "m")]
    (one,) = coalesced(twice)
    assert one["context"]["count"] == 2
    internal, ended = blocking("x", "internal", "m"), blocking("operation_terminated", "operation", "m")
    assert CommandResult.resolve("c", diagnostics=[internal, ended]).exit_code == 143
    assert CommandResult.resolve("c", "partial").outcome == "internal_failure"
    assert CommandResult.resolve("c", "partial", result={}).exit_code == 3
    out, err = human(CommandResult.resolve("c", diagnostics=[Diagnostic("a", "warning", "input", "none", "bad\x1b[31m")]))
    assert "\x1b" not in err and "success" in out


def test_issue_diagnostics(spark):
    issues = spark.createDataFrame([("input_unavailable", "/x", "m", None)], "kind string, path string, message string, os_error_kind string")
    assert diagnostics.from_issues(issues, True).first().impact == "degrades_coverage"
    assert diagnostics.from_issues(issues, False).first().code == "invalid_command_input"


def test_command_line(tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("HOME", str(tmp_path))
    assert cli.main(["--json", "bogus"]) == 2
    assert json.loads(capsys.readouterr().out)["diagnostics"][0]["code"] == "invalid_invocation"
    assert cli.main(["--no-config", "config", "explain", "scan.probe_media"]) == 0


def test_configuration_needs_no_session(tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("HOME", str(tmp_path))
    told = {}
    for line in (["validate"], ["show"], ["explain", "scan.probe_media"], ["explain", "no.such"]):
        code = cli.main(["--no-config", "--json", "config", *line])
        told[" ".join(line)] = code, json.loads(capsys.readouterr().out)
    assert [code for code, _ in told.values()] == [0, 0, 0, 2]
    assert told["validate"][1]["result"] == {"valid": True, "loaded_sources": 0}
    policy.verify_fingerprints({k: v for k, v in told["show"][1]["result"].items() if k not in ("sources", "shadowed")})
    assert told["explain scan.probe_media"][1]["result"]["setting"] == "evidence_policy.probe_media"
    assert [d["code"] for d in told["explain no.such"][1]["diagnostics"]] == ["configuration_setting_unknown"]


@pytest.mark.parametrize("ends", ["well", "badly"])
def test_a_command_leaves_the_session_as_it_was(engine, ends):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [engine.spark.conf.get(n, None) for n in names]
    held = []

    def work():
        held.extend(engine.spark.conf.get(n) for n in names)
        if ends == "badly":
            raise OSError("m")
        return CommandResult.resolve("c", result={})

    assert engine._guard("c", work).exit_code == (0 if ends == "well" else 1)
    assert held == ["-1", "-1"] and [engine.spark.conf.get(n, None) for n in names] == before


# --- cache and graph


def test_cache_hits_need_a_full_signature(spark):
    ddl = "path_key string, size_bytes bigint, modified_unix_ns bigint, filesystem_id string, file_id string, changed_unix_ns bigint"
    stored = spark.createDataFrame([("/a", 1, None, "d", "1", 5, "h", "p1")], ddl + ", content_hash string, probe_signature string")

    def hit(row, probe=None):
        return cache.lookup(spark.createDataFrame([row], ddl), stored, probe).first().cache_hit

    assert hit(("/a", 1, None, "d", "1", 5)) and hit(("/a", 1, None, "d", "1", 5), "p1")
    assert not hit(("/a", 1, None, "d", "1", 6)) and not hit(("/a", 1, None, None, "1", 5)) and not hit(("/a", 1, None, "d", "1", 5), "p2")


def test_graph(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a")], "id string, depends_on string")
    assert dict(graph.dag_rank(nodes, edges).collect()) == {"a": 0, "b": 1, "c": 2}
    with pytest.raises(graph.CycleError):
        graph.dag_rank(nodes, edges.union(spark.createDataFrame([("a", "c")], "id string, depends_on string")))
    one, two = spark.createDataFrame([("x",), ("y",)], "k string"), spark.createDataFrame([("y",), ("z",)], "k string")
    assert {tuple(r) for r in graph.coverage_gaps(one, two, "k").collect()} == {("missing", "x"), ("unexpected", "z")}
    assert graph.duplicate_ids(one.union(one), "k").count() == 2


def test_incremental_scan(spark, tmp_path):
    from pyspark.sql import functions as F

    from sedimark.streaming import incremental

    store = StateStore(spark, str(tmp_path / "state")).open()
    (tmp_path / "c").mkdir()
    (tmp_path / "c/a").write_text("x")
    seen = []

    def analyse(rows):
        seen.append(rows.count())
        return rows.select("path_key", "size_bytes", "modified_unix_ns", "filesystem_id", "file_id", "changed_unix_ns", F.lit("h").alias("content_hash"), F.lit("current").alias("evidence_validity"), *(F.lit(None).alias(c) for c in ("content_type", "media_kind", "status", "warnings", "media", "probe_signature")))

    for step in ("one", "two"):
        filesystem.discover(spark, [str(tmp_path / "c")]).files.write.mode("append").parquet(str(tmp_path / "listings"))
        incremental.follow(incremental.listings(spark, str(tmp_path / "listings")), store, analyse, str(tmp_path / "cp")).awaitTermination()
        if step == "one":
            (tmp_path / "c/b").write_text("y")
    assert seen == [1, 1] and store.cache().count() == 2


def test_the_rest_works_without_the_training_subpackage(tmp_path):
    """As the folders are when llm, its tests and the pipeline are deleted."""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(repo, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'exact_duplicate_groups' in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True)
