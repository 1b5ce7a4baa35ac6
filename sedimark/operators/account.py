"""One-row accounts of a scan: storage, counters, reclaimability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.operators.relate import clamped, object_key


def _total(column: str):
    return F.coalesce(F.sum(F.col(column).cast("decimal(38,0)")), F.lit(0))


def run_reclaimability(groups: DataFrame) -> DataFrame:
    """unknown without groups; estimated if every group is; else unknown because of extent sharing."""
    one = groups.agg(F.count("*").alias("n"), F.bool_and(F.col("reclaim_status") == "estimated").alias("sure"))
    known = F.when(F.col("n") == 0, F.lit(False)).otherwise(F.col("sure"))
    codes = F.when((F.col("n") > 0) & ~F.col("sure"), F.array(F.lit("extent_sharing_unknown"))).otherwise(F.array().cast("array<string>"))
    return one.select(F.when(known, "estimated").otherwise("unknown").alias("status"), codes.alias("reason_codes"))


def _accounted(rows: DataFrame, counters: dict) -> DataFrame:
    """One row of totals over paths, objects and groups, from one pass over the rows.

    Paths are summed by object, objects by size and content, and those once more; each sum carries the ones
    before it, so nothing is joined.  Objects without current evidence or a hash are one key of partial sums.
    ``counters`` are sums over paths by name.
    """
    first = F.struct("components", "path_key", "observation_id")
    identified = (F.col("filesystem_id").isNotNull() & F.col("file_id").isNotNull()).alias("has_identity")
    carried = F.struct("size_bytes", "content_hash", "allocated_size_bytes", "evidence_validity", identified)
    objects = rows.groupBy(object_key().alias("object")).agg(
        F.min_by(carried, first).alias("f"), F.count("*").alias("paths"), _total("size_bytes").alias("path_bytes"), *(F.sum(test.cast("long")).alias(name) for name, test in counters.items())
    )
    objects = objects.select("f.*", "paths", "path_bytes", *counters)
    eligible = (F.col("evidence_validity") == "current") & F.col("content_hash").isNotNull()
    sums = ("path_bytes", "object_bytes", "allocated", "unknown_allocation_object_count", "hard_link_alias_path_count", *counters)
    by_content = objects.groupBy(F.when(eligible, F.col("size_bytes")).alias("size"), F.when(eligible, F.col("content_hash")).alias("content")).agg(
        F.count("*").alias("objects"), F.sum("paths").alias("paths"), F.sum("path_bytes").alias("path_bytes"), _total("size_bytes").alias("object_bytes"), _total("allocated_size_bytes").alias("allocated"),
        F.count_if(F.col("allocated_size_bytes").isNull()).alias("unknown_allocation_object_count"), F.sum(F.when(F.col("has_identity"), F.col("paths") - 1).otherwise(0)).alias("hard_link_alias_path_count"),
        *(F.sum(name).alias(name) for name in counters),
    )
    group = F.col("content").isNotNull() & (F.col("objects") > 1)
    spare = clamped(F.col("size").cast("decimal(19,0)") * (F.col("objects") - 1).cast("decimal(18,0)"))
    return by_content.agg(
        F.coalesce(F.sum("objects"), F.lit(0)).alias("unique_object_count"), F.coalesce(F.sum("paths"), F.lit(0)).alias("file_count"), F.count_if(group).alias("exact_duplicate_groups"),
        F.coalesce(F.sum(F.when(group, F.col("objects"))), F.lit(0)).alias("exact_duplicate_files"), F.coalesce(F.sum(F.when(group, spare).cast("decimal(38,0)")), F.lit(0)).alias("reclaimable"),
        *(F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in sums),
    )


def storage_summary(rows: DataFrame) -> DataFrame:
    """Bytes by path, by object, allocated, in aliases and in duplicates; totals stop at the greatest long."""
    return _accounted(rows, {}).select(
        clamped(F.col("path_bytes")).alias("path_logical_bytes"),
        clamped(F.col("object_bytes")).alias("unique_object_logical_bytes"),
        clamped(F.col("allocated")).alias("known_allocated_bytes"),
        "unknown_allocation_object_count",
        F.greatest(clamped(F.col("path_bytes")) - clamped(F.col("object_bytes")), F.lit(0)).alias("hard_link_alias_logical_bytes"),
        clamped(F.col("reclaimable")).alias("duplicate_logical_bytes"),
        F.lit(None).cast("bigint").alias("estimated_reclaimable_allocated_bytes"),
    )


def scan_summary(rows: DataFrame) -> DataFrame:
    """The twelve counters of a scan."""
    counters = {
        "media_files": F.col("media_kind").isin("image", "video", "audio"), "unsupported_files": F.col("status") == "unsupported", "unreadable_files": F.col("status") == "unreadable",
        "cache_hits": F.col("cache_hit"), "unstable_observation_count": F.col("evidence_validity") != "current",
    }
    return _accounted(rows, counters).select(
        "file_count", clamped(F.col("path_bytes")).alias("total_bytes"), "media_files", "unsupported_files", "unreadable_files", "exact_duplicate_groups", "exact_duplicate_files",
        clamped(F.col("reclaimable")).alias("reclaimable_bytes"), "cache_hits", "unique_object_count", "hard_link_alias_path_count", "unstable_observation_count",
    )


def is_partial(summary: DataFrame, warnings: int = 0) -> DataFrame:
    """Whether a stored scan covers only a part: unstable or unreadable rows, or run warnings."""
    return summary.select(((F.col("unstable_observation_count") > 0) | (F.col("unreadable_files") > 0) | F.lit(warnings > 0)).alias("partial"))
