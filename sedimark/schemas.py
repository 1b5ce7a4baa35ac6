"""Row types, closed vocabularies and the defaults of older document versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Wire names of the closed vocabularies.
MEDIA_KINDS = ("image", "video", "audio", "other", "unknown")
STATUSES = ("analyzed", "unsupported", "unreadable")
STABILITIES = (
    "stable", "changed_during_hash", "changed_during_probe", "replaced_during_scan", "disappeared_during_scan",
    "became_symlink", "filesystem_boundary_changed", "metadata_unavailable", "retry_exhausted", "unreadable",
)
VALIDITIES = ("current", "stale", "unavailable")
ALLOCATION_SOURCES = ("st_blocks512", "unavailable")
EXTENT_SHARING = ("unknown", "not_detected")
RECLAIM_STATUSES = ("estimated", "unknown")
RECLAIM_REASONS = (
    "filesystem_identity_unavailable", "allocation_metadata_unavailable", "unobserved_hard_links",
    "extent_sharing_unknown", "arithmetic_overflow", "platform_metadata_unsupported",
)
ISSUE_KINDS = ("input_unavailable", "input_excluded_by_policy", "invalid_input_type", "traversal_incomplete", "path_changed")
RUN_STATUSES = ("running", "completed", "interrupted", "failed")
EXIT_CODES = {
    "success": 0, "internal_failure": 1, "invalid_input": 2, "partial_success": 3,
    "capability_unavailable": 4, "stale_state": 5, "interrupted": 130, "terminated": 143,
}

PATH = "struct<encoding: string, value: string, base64: string>"
IDENTITY = "struct<platform: string, filesystem_id: string, file_id: string, link_count: bigint>"
ALLOCATION = "struct<logical_size_bytes: bigint, allocated_size_bytes: bigint, allocation_source: string, extent_sharing_status: string>"
STREAM = "struct<index: bigint, codec_type: string, codec_name: string, width: bigint, height: bigint, sample_rate: bigint, channels: bigint>"
MEDIA = f"struct<format_name: string, duration_seconds: double, bit_rate: bigint, streams: array<{STREAM}>>"

DISCOVERED = (
    f"path {PATH}, path_key string, components array<string>, size_bytes bigint, modified_unix_ns bigint, "
    "changed_unix_ns bigint, device_id decimal(20,0), inode decimal(20,0), link_count bigint"
)
ISSUES = "kind string, path string, message string, os_error_kind string"
OBSERVATION = (
    f"observation_id string, run_id string, path {PATH}, path_key string, components array<string>, size_bytes bigint, "
    "modified_unix_ns bigint, changed_unix_ns bigint, device_id decimal(20,0), inode decimal(20,0), content_type string, "
    f"media_kind string, content_hash string, hash_algorithm string, media {MEDIA}, status string, cache_hit boolean, "
    f"warnings array<string>, filesystem_identity {IDENTITY}, storage_allocation {ALLOCATION}, "
    "observation_stability string, evidence_validity string, attempt_count bigint"
)

#: Columns that older documents lack, with the value that a reader puts there.
OBSERVATION_DEFAULTS = {"observation_stability": "stable", "evidence_validity": "current", "attempt_count": 1}
SUMMARY_DEFAULTS = {"unique_object_count": 0, "hard_link_alias_path_count": 0, "unstable_observation_count": 0}


def struct_type(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def column_names(ddl: str) -> list[str]:
    """The top-level column names; needs no session, so workers can ask."""
    out, depth, word = [], 0, ""
    for c in ddl + ",":
        depth += (c == "<") + (c == "(") - (c == ">") - (c == ")")
        if c == "," and depth == 0:
            out.append(word.split()[0].strip())
            word = ""
        else:
            word += c
    return out


def with_defaults(rows: DataFrame, ddl: str, defaults: dict[str, object]) -> DataFrame:
    """``rows`` in the columns of ``ddl``: those absent or null get their default, else null."""
    out = []
    for field in struct_type(ddl).fields:
        have = F.col(field.name) if field.name in rows.columns else F.lit(None)
        out.append(F.coalesce(have.cast(field.dataType), F.lit(defaults.get(field.name)).cast(field.dataType)).alias(field.name) if field.name in defaults else have.cast(field.dataType).alias(field.name))
    return rows.select(*out)
