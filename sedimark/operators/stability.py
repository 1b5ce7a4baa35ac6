"""How two signatures of one path differ, as a column and for single values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTITY = ("filesystem_id", "file_id")
CONTENT = ("size_bytes", "modified_unix_ns", "changed_unix_ns", "link_count")


def change_class(before: Column, after: Column, content_change: str) -> Column:
    """The stability that a pair of signature structs shows; the first test that holds decides.

    A structure has is_symlink, filesystem_id, file_id, link_count, size_bytes and both times.  Links
    count as content: one added meanwhile rejects the evidence.
    """
    whole = F.lit(True)
    for c in (*IDENTITY, *CONTENT):
        whole = whole & before[c].eqNullSafe(after[c])
    missing = before["filesystem_id"].isNull() | after["filesystem_id"].isNull() | before["changed_unix_ns"].isNull() | after["changed_unix_ns"].isNull()
    return (
        F.when(after["is_symlink"], "became_symlink")
        .when(before["filesystem_id"] != after["filesystem_id"], "filesystem_boundary_changed")
        .when(before["file_id"] != after["file_id"], "replaced_during_scan")
        .when(missing, "metadata_unavailable")
        .when(~whole, content_change)
        .otherwise("stable")
    )


def classify(before: dict, after: dict, content_change: str) -> str:
    """As ``change_class``, for two dictionaries."""
    if after["is_symlink"]:
        return "became_symlink"
    if None not in (before["filesystem_id"], after["filesystem_id"]) and before["filesystem_id"] != after["filesystem_id"]:
        return "filesystem_boundary_changed"
    if None not in (before["file_id"], after["file_id"]) and before["file_id"] != after["file_id"]:
        return "replaced_during_scan"
    if None in (before["filesystem_id"], after["filesystem_id"], before["changed_unix_ns"], after["changed_unix_ns"]):
        return "metadata_unavailable"
    return content_change if any(before[c] != after[c] for c in (*IDENTITY, *CONTENT)) else "stable"


def instability_of(message: Column) -> Column:
    """The stability named in an error text."""
    text = F.lower(message)
    return (
        F.when(text.contains("replaced"), "replaced_during_scan")
        .when(text.contains("disappeared") | text.contains("not found"), "disappeared_during_scan")
        .when(text.contains("symlink"), "became_symlink")
        .when(text.contains("changed"), "changed_during_hash")
        .when(text.contains("metadata"), "metadata_unavailable")
        .otherwise("unreadable")
    )
