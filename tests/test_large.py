"""What has to hold for collections that don't fit one process."""

import os

from sedimark.functions import blake3
from sedimark.sources import filesystem, observe


def test_small_files_are_hashed_side_by_side(tmp_path, monkeypatch):
    """300 files in a few compressions, not in some hundreds each; every other kind of path among them."""
    contents = [os.urandom(i * 11) for i in range(300)] + [os.urandom(observe.SMALL + 1)]
    raws = []
    for i, content in enumerate(contents):
        (tmp_path / f"f{i}").write_bytes(content)
        raws.append(os.fsencode(tmp_path / f"f{i}"))
    os.symlink(tmp_path / "f1", tmp_path / "link")
    raws[2:2] = [os.fsencode(tmp_path / "link"), os.fsencode(tmp_path / "gone")]
    expected = [(blake3.hash_one(c), "stable") for c in contents]
    expected[2:2] = [(None, "became_symlink"), (None, "disappeared_during_scan")]
    calls, compress = [], blake3._compress
    monkeypatch.setattr(blake3, "_compress", lambda *a: calls.append(1) or compress(*a))
    assert list(observe.hash_paths(raws)) == expected
    assert len(calls) < 100
    asked = [(raw, len(c), digest) for raw, c, (digest, _) in zip(raws[:2], contents[:2], expected)]
    assert list(observe.have_content(asked)) == [True, True]
    assert list(observe.have_content([(asked[1][0], 12, asked[1][2]), (asked[0][0], 0, "0" * 64)])) == [False, False]


def test_an_empty_file_has_a_hash_and_its_algorithm(tmp_path):
    (tmp_path / "f").touch()
    row = filesystem.file_row(os.fsencode(tmp_path / "f"), os.lstat(tmp_path / "f")) | {"needs_hash": True, "cache_hit": False}
    made = (observe.observe_file(row, filesystem.ScanOptions(probe_media=False), digest=observe._small) for _ in range(2))
    ((one, two),) = observe._side_by_side(made, "content_hash", lambda: False)
    assert one["content_hash"] == two["content_hash"] == blake3.hash_one(b"") and one["hash_algorithm"] == "blake3"


def test_long_messages_in_pieces():
    for size in (0, 1, 1025, blake3.SIDE_BY_SIDE - 1, blake3.SIDE_BY_SIDE, blake3.SIDE_BY_SIDE + 1, 3 * blake3.SIDE_BY_SIDE + 5000):
        message, whole = os.urandom(size), blake3.Hasher()
        for at in range(0, size, 700_001):
            whole.update(message[at : at + 700_001])
        assert whole.hexdigest() == blake3.hash_one(message)


def test_long_lists_stay_in_their_file(tmp_path, monkeypatch):
    """Any layout, items longer than what is read at once, and numbers and letters cut by the window."""
    import json

    from sedimark.runs import documents

    monkeypatch.setattr(documents, "READ", 7)
    monkeypatch.setattr(documents, "SHORT", 20)
    whole = {"schema": "x", "short": [1], "run": {"long": [{"a": "é🌌\n" * i, "b": [i, -1.5e10]} for i in range(40)]}, "empty": [], "numbers": list(range(995, 1030))}
    for layout in ({}, {"indent": 2, "ensure_ascii": False}):
        path = str(tmp_path / f"d{len(layout)}.json")
        with open(path, "w") as f:
            json.dump(whole, f, **layout)
        got = documents.load(path)
        assert isinstance(got["run"]["long"], documents.Items) and isinstance(got["numbers"], documents.Items)
        assert got == whole and got["run"]["long"][-1] == whole["run"]["long"][-1] and len(got["numbers"]) == 35
        assert json.loads("".join(documents.pieces(got))) == whole
        assert documents.members(path, "schema") == {"schema": "x"}


def test_a_scan_and_its_plan_are_streams(spark, tmp_path, monkeypatch):
    """Reports and plans in the order and shape of before, with lists that the driver doesn't hold."""
    import json

    from sedimark.runs import documents, policy
    from sedimark.runs.engine import Engine, Signals

    monkeypatch.setattr(documents, "SHORT", 0)
    top = tmp_path / "files"
    top.mkdir()
    for i in range(6):
        (top / f"f{i}").write_bytes(b"x" * (1 + i // 3))
    os.link(top / "f0", top / "again")
    os.link(top / "f5", top / "late")
    line = {"operational_policy.state_directory": str(tmp_path / "state"), "evidence_policy.probe_media": False}
    engine = Engine(spark, policy.resolve(line, no_config=True, environment={"HOME": str(tmp_path)}), Signals())
    scan = engine.scan([str(top)]).result
    assert all(isinstance(scan[k], documents.Items) for k in ("observations", "duplicate_groups", "hard_link_groups"))
    with open(os.path.join(scan["run"]["artifact_directory"], "report.json")) as f:
        stored = json.load(f)
    assert scan == stored and engine.report(scan["run"]["run_id"]).result == stored
    assert [o["path"]["value"].rpartition("/")[2] for o in stored["observations"]] == ["again", "f0", "f1", "f2", "f3", "f4", "f5", "late"]
    assert [[m["primary_path"].rpartition("/")[2] for m in g["members"]] for g in stored["duplicate_groups"]] == [["again", "f1", "f2"], ["f3", "f4", "f5"]]
    plan = engine.plan(scan["run"]["run_id"], str(tmp_path / "plan.json")).result
    assert isinstance(plan["actions"], documents.Items) and plan["summary"]["candidate_file_count"] == 5
    short = [{k: [p.rpartition("/")[2] for p in a[k]] for k in ("keep_alias_paths", "candidate_paths")} | {"n": len(a["preconditions"])} for a in plan["actions"]]
    assert short == [{"keep_alias_paths": ["f0"], "candidate_paths": ["f1", "f2"], "n": 4}, {"keep_alias_paths": [], "candidate_paths": ["f4", "f5", "late"], "n": 4}]


def test_a_command_broadcasts_no_table(spark, tmp_path, monkeypatch):
    """Every path of a scan goes into the cache and a plan; the driver must not gather them for a join."""
    from sedimark.operators import cache
    from sedimark.runs import documents, policy
    from sedimark.runs.engine import Engine, Signals

    name = "spark.sql.autoBroadcastJoinThreshold"
    top, before, plans = tmp_path / "files", spark.conf.get(name), []
    top.mkdir()
    for i in range(4):
        (top / f"f{i}").write_bytes(b"x")

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    upsert, lines = cache.upsert, documents.lines
    monkeypatch.setattr(cache, "upsert", lambda *a: seen(upsert(*a)))
    monkeypatch.setattr(documents, "lines", lambda rows, *a: lines(seen(rows), *a))
    line = {"operational_policy.state_directory": str(tmp_path / "state"), "evidence_policy.probe_media": False}
    engine = Engine(spark, policy.resolve(line, no_config=True, environment={"HOME": str(tmp_path)}), Signals())
    run = engine.scan([str(top)]).result["run"]["run_id"]
    assert engine.plan(run, str(tmp_path / "plan.json")).exit_code == 0
    assert any("Join" in p for p in plans) and not any("Broadcast" in p for p in plans)
    assert spark.conf.get(name) == before


def test_a_command_holds_each_list_once_on_disk(spark, tmp_path, monkeypatch):
    """Sorted lines go as they are copied, shuffles as their query ends; a compressed document is read like a plain one."""
    import gzip

    from sedimark.runs import documents
    from sedimark.runs.engine import Engine, Signals
    from sedimark.runs.outcome import CommandResult

    rows = spark.createDataFrame([(0, f"{i:02}", 0, "", f'{{"n": {i}}}') for i in range(40)], documents.LINES)
    written = documents.write(str(tmp_path / "d.json"), {"schema": "x"}, {"numbers": rows.repartition(5)}, str(tmp_path / "spool"))
    assert list(written["numbers"]) == [{"n": i} for i in range(40)]
    assert not [x for x in os.listdir(tmp_path / "spool/numbers") if x.startswith("part-")]

    monkeypatch.setattr(documents, "SHORT", 20)
    with gzip.open(tmp_path / "d.gz", "wt", 1, "utf-8") as f:
        f.writelines(documents.pieces(written))
    read = documents.load(str(tmp_path / "d.gz"), gzip.open)
    assert isinstance(read["numbers"], documents.Items) and read == written and read["numbers"][-1] == {"n": 39}

    name, held = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []
    before = spark.conf.get(name)
    Engine(spark, None, Signals())._guard("c", lambda: held.append(spark.conf.get(name)) or CommandResult.resolve("c", result={}))
    assert held == ["true"] and spark.conf.get(name) == before


def test_paths_of_a_plan_by_stored_actions(spark):
    """Groups, aliases and an outdated observation; the same rows whether the actions are a table or not."""
    from sedimark.plans import duplicates

    ddl = (
        "observation_id string, path_key string, components array<string>, size_bytes bigint, modified_unix_ns bigint, content_hash string, filesystem_id string, file_id string, link_count bigint, "
        "allocated_size_bytes bigint, extent_sharing_status string, evidence_validity string"
    )
    told = [("/b", "h", "1"), ("/a", "h", "2"), ("/z", "h", "2"), ("/c", "k", "3"), ("/d", "k", None), ("/e", "k", None), ("/f", "m", "4")]
    rows = spark.createDataFrame([(p, p, [p], 1, 5, h, "d" if n else None, n, 1, 512, "unknown", "changed" if p == "/e" else "current") for p, h, n in told], ddl)
    plain = {tuple(r) for r in duplicates.paths(rows).collect()}
    acts = duplicates.actions(rows)
    keep = {a.group_id: a.keep_path for a in acts.collect()}
    assert {tuple(r) for r in duplicates.paths(rows, acts=acts).collect()} == {(*r, keep[r[0]]) for r in plain}
    assert {(r[1], r[2]) for r in plain} == {("/a", "keep"), ("/z", "keep"), ("/b", "candidate"), ("/c", "keep"), ("/d", "candidate")}
