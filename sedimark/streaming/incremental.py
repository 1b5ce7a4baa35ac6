"""Incremental scans: a stream of discovered files against the analysis cache."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sedimark.operators import cache
from sedimark.runs.state import StateStore
from sedimark.schemas import DISCOVERED


def listings(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of discovered files from Parquet listings that appear in a folder."""
    return spark.readStream.schema(DISCOVERED).parquet(folder)


def follow(found: DataFrame, store: StateStore, analyse: Callable[[DataFrame], DataFrame], checkpoint: str):
    """Analyse only what the cache doesn't hold, batch by batch; a batch done again changes nothing.

    ``analyse`` turns discovered rows into cache rows.  Returns the started query, which ends when all
    listings there are have been read.
    """

    def batch(rows: DataFrame, _number: int) -> None:
        keyed = rows.dropDuplicates(["path_key"]).selectExpr("*", "cast(device_id as string) as filesystem_id", "cast(inode as string) as file_id")
        looked = cache.lookup(keyed, store.cache().select("path_key", *cache.SIGNATURE, "content_hash"))
        fresh = looked.where("not cache_hit").drop("cache_hit", "cached_content_hash")
        store.remember(analyse(fresh))

    return found.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
