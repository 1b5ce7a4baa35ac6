"""Review-only plans: which copy of each exact group stays, which are candidates, what must still hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.operators.relate import exact_groups, exact_members, object_key, sha256

SAFETY = {
    "mutates_files": False,
    "requires_explicit_apply": True,
    "description": "This plan is evidence for review; nothing in it has been or will be carried out.",
}


def actions(rows: DataFrame, digest=sha256) -> DataFrame:
    """One action for each group: keep the member of the least path, review the others."""
    return exact_groups(rows, digest).select(
        "group_id",
        "keep_path",
        (F.col("observed_path_count") - 0).alias("path_count"),
        "member_count",
        F.col("reclaimable_bytes").alias("potential_reclaimable_bytes"),
        F.lit("exact_duplicate").alias("classification"),
        F.lit("review_duplicates").alias("proposed_operation"),
        "reasons",
        "reclaim_status",
        "size_bytes",
        "content_hash",
    )


def paths(rows: DataFrame, digest=sha256, acts: DataFrame | None = None) -> DataFrame:
    """(group_id, path_key, role, precondition columns) for every path of every member.

    The kept member's paths have role "keep", all others "candidate".  Size and hash expected are the
    group's, the modification time is the path's own.  ``acts`` are the actions on ``rows``, where they are a
    table already; each row then has its group's ``keep_path`` too.
    """
    members = exact_members(rows, digest).select("group_id", "object", "primary_path", F.col("size_bytes").alias("expected_size_bytes"), F.col("content_hash").alias("expected_content_hash"))
    kept = (exact_groups(rows, digest) if acts is None else acts).select("group_id", "keep_path")
    own = rows.select(object_key().alias("object"), "path_key", "modified_unix_ns")
    joined = members.join(kept, "group_id").join(own, "object")
    return joined.select(
        "group_id",
        "path_key",
        F.when(F.col("primary_path") == F.col("keep_path"), "keep").otherwise("candidate").alias("role"),
        "expected_size_bytes",
        F.col("modified_unix_ns").alias("expected_modified_unix_ns"),
        "expected_content_hash",
        *([] if acts is None else ["keep_path"]),
    )


def summary(rows: DataFrame, digest=sha256) -> DataFrame:
    """Actions, candidate paths (not objects) and the plain sum of reclaimable bytes."""
    by_action = actions(rows, digest).agg(F.count("*").alias("action_count"), F.coalesce(F.sum("potential_reclaimable_bytes"), F.lit(0)).alias("potential_reclaimable_bytes"))
    candidates = paths(rows, digest).agg(F.count_if(F.col("role") == "candidate").alias("candidate_file_count"))
    return by_action.crossJoin(candidates).select("action_count", "candidate_file_count", "potential_reclaimable_bytes")
