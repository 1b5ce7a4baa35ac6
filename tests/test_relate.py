from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sedimark.operators import account, relate
from sedimark.plans import duplicates

DDL = (
    "observation_id string, path_key string, components array<string>, size_bytes bigint, modified_unix_ns bigint, content_hash string, filesystem_id string, file_id string, "
    "link_count bigint, allocated_size_bytes bigint, extent_sharing_status string, evidence_validity string, status string, media_kind string, cache_hit boolean"
)


def rows(spark, *items, size=10):
    """Items: (path, hash[, file system, file, links[, validity]])."""
    out = []
    for path, digest, *rest in items:
        fs, file, links, validity = (*rest, *(None, None, None, "current")[len(rest) :])
        out.append((path, path, path.split("/"), size, 1, digest, fs, file, links, 4096 if fs else None, "unknown", validity, "unsupported", "unknown", False))
    return spark.createDataFrame(out, DDL)


def test_two_equal_files_are_one_group(spark):
    (group,) = relate.exact_groups(rows(spark, ("/a", "same"), ("/b", "same"), ("/c", "different"))).collect()
    assert (group.member_count, group.reclaimable_bytes, group.keep_path) == (2, 10, "/a")


def test_aliases_fold_into_one_member(spark):
    found = rows(spark, ("/a", "h", "d", "1", 2), ("/b", "h", "d", "1", 2), ("/c", "h", "d", "2", 1))
    (group,) = relate.exact_groups(found).collect()
    assert (group.member_count, group.observed_path_count, group.reclaimable_bytes) == (2, 3, 10)


def test_aliases_alone_are_no_group(spark):
    assert relate.exact_groups(rows(spark, ("/x", "h", "d", "1", 2), ("/y", "h", "d", "1", 2))).count() == 0


def test_stale_evidence_is_left_out(spark):
    found = rows(spark, ("/a", "same", None, None, None, "stale"), ("/b", "same"), ("/c", "same"))
    assert relate.exact_groups(found).first().keep_path == "/b"


def test_a_primary_without_evidence_hides_its_aliases(spark):
    found = rows(spark, ("/a", "h", "d", "1", 2, "stale"), ("/b", "h", "d", "1", 2), ("/c", "h", "d", "2", 1))
    assert relate.exact_groups(found).count() == 0


def test_component_order_decides_the_primary_and_byte_order_the_path(spark):
    found = rows(spark, ("/r/a.b", "h", "d", "1", 2), ("/r/a/b", "h", "d", "1", 2))
    (row,) = relate.fold_aliases(found).collect()
    assert (row.observation_id, row.primary_path) == ("/r/a/b", "/r/a.b")


def test_links_all_met_still_count_as_links(spark):
    found = rows(spark, ("/a", "h", "d", "1", 2), ("/b", "h", "d", "1", 2), ("/c", "h", "d", "2", 1))
    assert "unobserved_hard_links" in relate.exact_groups(found).first().reasons
    (group,) = relate.hard_link_groups(found).collect()
    assert (group.paths, group.unobserved_link_count) == (["/a", "/b"], 0)


def test_more_paths_than_links_is_unknown(spark):
    assert relate.hard_link_groups(rows(spark, ("/a", "h", "d", "1", 1), ("/b", "h", "d", "1", 1))).first().unobserved_link_count is None


def test_empty_files_group_with_nothing_to_reclaim(spark):
    assert relate.exact_groups(rows(spark, ("/a", "h"), ("/b", "h"), size=0)).first().reclaimable_bytes == 0


def test_totals_stop_at_the_greatest_long(spark):
    found = rows(spark, ("/a", "h"), ("/b", "h"), ("/c", "h"), size=(1 << 62))
    assert relate.exact_groups(found).first().reclaimable_bytes == (1 << 63) - 1
    assert account.storage_summary(found).first().path_logical_bytes == (1 << 63) - 1


def test_nothing_at_all(spark):
    none = rows(spark, ("/a", "h")).limit(0)
    assert relate.exact_groups(none).count() == 0
    assert account.run_reclaimability(relate.exact_groups(none)).first().asDict() == {"status": "unknown", "reason_codes": []}
    assert account.scan_summary(none).first().file_count == 0
    assert duplicates.summary(none).first().asDict() == {"action_count": 0, "candidate_file_count": 0, "potential_reclaimable_bytes": 0}


def test_the_plan_keeps_the_least_path(spark):
    found = rows(spark, ("/z", "h"), ("/a", "h"))
    assert duplicates.actions(found).first().keep_path == "/a"
    assert {(p.path_key, p.role) for p in duplicates.paths(found).collect()} == {("/a", "keep"), ("/z", "candidate")}


def by_loops(items):
    """The groups by plain loops: {(size, hash): (members, paths, least path)}."""
    objects = defaultdict(list)
    for i, (path, digest, fs, file, _links, validity) in enumerate(items):
        objects[(fs, file) if fs else i].append((path.split("/"), path, digest, validity))
    groups = defaultdict(list)
    for found in objects.values():
        _, _, digest, validity = min(found)
        if validity == "current" and digest:
            groups[digest].append((min(p for _, p, *_ in found), len(found)))
    return {d: (len(m), sum(n for _, n in m), min(p for p, _ in m)) for d, m in groups.items() if len(m) > 1}


items = st.lists(
    st.tuples(st.sampled_from("abc"), st.sampled_from("xyz"), st.sampled_from([None, "1", "2", "3"]), st.sampled_from(["current", "current", "stale"]), st.sampled_from([".b", "/b", ""])),
    min_size=1,
    max_size=12,
)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(items)
def test_groups_equal_plain_loops(spark, drawn):
    made = [(f"/r{i}/{a}{tail}", h, "d" if f else None, f, 1 if f else None, v) for i, (a, h, f, v, tail) in enumerate(drawn)]
    got = {g.content_hash: (g.member_count, g.observed_path_count, g.keep_path) for g in relate.exact_groups(rows(spark, *made)).collect()}
    assert got == by_loops(made)
