"""The analysis cache as a keyed table: null-safe lookup and upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What must be equal for a cached analysis to hold; the middle three must also be known.
SIGNATURE = ("size_bytes", "modified_unix_ns", "filesystem_id", "file_id", "changed_unix_ns")
REQUIRED = ("filesystem_id", "file_id", "changed_unix_ns")


def lookup(found: DataFrame, cache: DataFrame, probe_signature: str | None = None) -> DataFrame:
    """``found`` with the cached columns (prefixed ``cached_``) and ``cache_hit``.

    Equality is null-safe, yet a row without identity or change time never hits.  With a probe
    signature, only rows made with the same one hit; without, any does.
    """
    own = [c for c in cache.columns if c != "path_key" and c not in SIGNATURE]
    side = cache.select(F.col("path_key").alias("__key"), *(F.col(c).alias(f"__{c}") for c in SIGNATURE), *(F.col(c).alias(f"cached_{c}") for c in own))
    on = found["path_key"] == side["__key"]
    for c in SIGNATURE:
        on = on & found[c].eqNullSafe(side[f"__{c}"])
    for c in REQUIRED:
        on = on & found[c].isNotNull()
    if probe_signature is not None:
        on = on & (side["cached_probe_signature"] == probe_signature)
    joined = found.join(side, on, "left")
    return joined.withColumn("cache_hit", F.col("__key").isNotNull()).drop("__key", *(f"__{c}" for c in SIGNATURE))


def storable(rows: DataFrame) -> DataFrame:
    """Rows that may enter the cache: current evidence with a full identity."""
    known = F.lit(True)
    for c in REQUIRED:
        known = known & F.col(c).isNotNull()
    return rows.where(known & (F.col("evidence_validity") == "current"))


def upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache after ``new`` replaced or added its paths; ``new`` has one row a path."""
    kept = cache.join(new.select("path_key"), "path_key", "left_anti")
    return kept.unionByName(storable(new).select(*cache.columns)).unionByName(cache.join(new.select("path_key").subtract(storable(new).select("path_key")), "path_key", "left_semi"))
