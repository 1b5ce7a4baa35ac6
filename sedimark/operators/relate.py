"""Relations among observations: size candidates, alias folding, hard links, exact groups.

The operators work on *facts*, one flat row for each observed path::

    observation_id, path_key, components, size_bytes, modified_unix_ns, content_hash, filesystem_id,
    file_id, link_count, allocated_size_bytes, extent_sharing_status, evidence_validity

``components`` sorts as paths were discovered, ``path_key`` as paths are shown.  Aggregates use map-side
sums and least values; no operator gathers a group of duplicates into one row or one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = (1 << 63) - 1


def facts(observations: DataFrame) -> DataFrame:
    """The flat columns of nested observations, with 0/1 flags of what is available."""
    identity, allocation = F.col("filesystem_identity"), F.col("storage_allocation")
    return observations.select(
        "observation_id", "path_key", "components", "size_bytes", "modified_unix_ns", "content_hash", "status", "media_kind", "cache_hit", "observation_stability", "evidence_validity",
        identity["filesystem_id"].alias("filesystem_id"), identity["file_id"].alias("file_id"), identity["link_count"].alias("link_count"),
        allocation["allocated_size_bytes"].alias("allocated_size_bytes"), allocation["extent_sharing_status"].alias("extent_sharing_status"),
        identity.isNotNull().cast("int").alias("identity_available"), allocation["allocated_size_bytes"].isNotNull().cast("int").alias("allocation_available"),
    )


def clamped(total: Column) -> Column:
    """A decimal total as a long that stops at the greatest one."""
    return F.least(total.cast("decimal(38,0)"), F.lit(MOST).cast("decimal(38,0)")).cast("bigint")


def size_frequency(rows: DataFrame) -> DataFrame:
    """Paths of each size."""
    return rows.groupBy("size_bytes").agg(F.count("*").alias("file_count"))


def size_candidates(rows: DataFrame) -> DataFrame:
    """Paths whose size another path has too: only these need a content hash.

    A count and a semi join rather than a window, so a size that many files have isn't one task's rows.
    """
    shared = size_frequency(rows).where("file_count > 1").select("size_bytes")
    return rows.join(shared, "size_bytes", "left_semi")


def split_candidates(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, the rest); an expensive function then runs on the first alone."""
    alone = size_frequency(rows).where("file_count = 1").select("size_bytes")
    return size_candidates(rows), rows.join(alone, "size_bytes", "left_semi")


def eligible(rows: DataFrame) -> DataFrame:
    return rows.where("evidence_validity = 'current' and content_hash is not null")


def object_key() -> Column:
    """One key for each file object: its identity, or the observation itself where there is none."""
    known = F.col("filesystem_id").isNotNull() & F.col("file_id").isNotNull()
    return F.when(known, F.struct(F.col("filesystem_id").alias("a"), F.col("file_id").alias("b"))).otherwise(F.struct(F.lit(None).cast("string").alias("a"), F.col("observation_id").alias("b")))


def fold_aliases(rows: DataFrame) -> DataFrame:
    """One row for each file object: its first-discovered observation, least path and number of paths."""
    first = F.struct("components", "path_key", "observation_id")
    carried = ("observation_id", "size_bytes", "content_hash", "filesystem_id", "file_id", "link_count", "allocated_size_bytes", "extent_sharing_status", "evidence_validity")
    return (
        rows.withColumn("object", object_key())
        .groupBy("object")
        .agg(
            F.min_by(F.struct(*carried, F.col("path_key").alias("own_path")), first).alias("primary"),
            F.min("path_key").alias("primary_path"),
            F.count("*").alias("observed_path_count"),
        )
        .select("object", "primary.*", "primary_path", "observed_path_count")
    )


def aliases(rows: DataFrame) -> DataFrame:
    """(object, path_key, is_primary): every path, marked if it is its object's least."""
    keyed = rows.withColumn("object", object_key())
    least = keyed.groupBy("object").agg(F.min("path_key").alias("primary_path"))
    return keyed.join(least, "object").withColumn("is_primary", F.col("path_key") == F.col("primary_path"))


def hard_link_groups(rows: DataFrame, least: int = 2) -> DataFrame:
    """Objects that were met under several paths; sizes are those of the first-discovered path.

    Validity of the evidence plays no part.  The paths of one object (a file system allows a bounded
    number of links) are listed in order.
    """
    first = F.struct("components", "path_key")
    groups = (
        rows.where("filesystem_id is not null and file_id is not null")
        .groupBy("filesystem_id", "file_id")
        .agg(
            F.array_sort(F.collect_list("path_key")).alias("paths"),
            F.count("*").alias("observed_path_count"),
            F.min_by(F.struct("link_count", "size_bytes", "allocated_size_bytes"), first).alias("first"),
        )
        .where(F.col("observed_path_count") >= least)
    )
    return groups.select("filesystem_id", "file_id", "paths", "observed_path_count", "first.*").withColumn("unobserved_link_count", unobserved(F.col("link_count"), F.col("observed_path_count")))


def unobserved(link_count: Column, observed: Column) -> Column:
    """Links that the scan didn't meet; null if unknown or if more were met than there should be."""
    return F.when(link_count >= observed, link_count - observed)


def with_unobserved_links(groups: DataFrame) -> DataFrame:
    """The hard-link groups of which some links lie outside what was scanned."""
    return groups.where("unobserved_link_count > 0")


def group_id(prefix: str, first: Column, second: Column, digest) -> Column:
    """``prefix`` and 16 hexadecimal digits of the digest of "first:second"."""
    return F.concat(F.lit(prefix), F.substring(digest(F.concat_ws(":", first.cast("string"), second)), 1, 16))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_members(rows: DataFrame, digest=sha256) -> DataFrame:
    """One row for each member of an exact duplicate group, a file object with current evidence.

    Only an object's first-discovered observation is judged: if that isn't current, its aliases are
    hidden with it.
    """
    objects = eligible(fold_aliases(rows))
    shared = objects.groupBy("size_bytes", "content_hash").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    members = objects.join(shared, ["size_bytes", "content_hash"], "left_semi")
    return members.withColumn("group_id", group_id("exact-", F.col("size_bytes"), F.col("content_hash"), digest))


def reasons() -> Column:
    """Why the space of a group's members can't be promised, in a fixed order."""
    tests = (
        ("filesystem_identity_unavailable", F.bool_or(F.col("filesystem_id").isNull())),
        ("allocation_metadata_unavailable", F.bool_or(F.col("allocated_size_bytes").isNull())),
        ("unobserved_hard_links", F.bool_or(F.coalesce(F.col("link_count"), F.lit(1)) > 1)),
        ("extent_sharing_unknown", F.bool_or(F.coalesce(F.col("extent_sharing_status"), F.lit("unknown")) == "unknown")),
    )
    return F.array_compact(F.array(*(F.when(test, name) for name, test in tests)))


def exact_groups(rows: DataFrame, digest=sha256) -> DataFrame:
    """One row for each exact duplicate group; sums and least values only, so any size of group does."""
    grouped = (
        eligible(fold_aliases(rows))
        .groupBy("size_bytes", "content_hash")
        .agg(
            F.count("*").alias("member_count"),
            F.sum(F.col("observed_path_count").cast("decimal(38,0)")).alias("paths"),
            F.min("primary_path").alias("keep_path"),
            reasons().alias("reasons"),
        )
        .where("member_count > 1")
    )
    return grouped.select(
        group_id("exact-", F.col("size_bytes"), F.col("content_hash"), digest).alias("group_id"),
        "size_bytes",
        "content_hash",
        "member_count",
        clamped(F.col("paths")).alias("observed_path_count"),
        clamped(F.col("size_bytes").cast("decimal(19,0)") * (F.col("member_count") - 1).cast("decimal(18,0)")).alias("reclaimable_bytes"),
        "keep_path",
        "reasons",
        F.when(F.size("reasons") == 0, "estimated").otherwise("unknown").alias("reclaim_status"),
    )
