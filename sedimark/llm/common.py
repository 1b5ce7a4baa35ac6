"""Shared pieces: fan-out, file systems of executors, and reading Arrow text as bytes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.storage import cut, release, scratch_path

__all__ = ["cut", "doc_rows", "fan_out", "filesystem", "mix64", "release", "scratch_path", "slices", "table", "text_bytes"]

#: Uncompressed text that one task should hold, unless the session's spark.sedimark.partBytes says more or less.
PART_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filesystem(uri: str):
    """(pyarrow filesystem, path in it) for a folder URI or a plain path."""
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        if uri.startswith("file:"):
            return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def fan_out(df: DataFrame, part_bytes: int | None = None) -> int:
    """Partitions for a shuffle of ``df``: the session's number, more if parts would be too large.

    The size is the planner's estimate from file sizes, doubled for compression, so no job runs.
    """
    spark = df.sparkSession
    part_bytes = part_bytes or int(spark.conf.get("spark.sedimark.partBytes", str(PART_BYTES)))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = 0 if size > 1 << 60 else math.ceil(2 * size / part_bytes)
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), known, 1)


def doc_rows(docs: DataFrame) -> DataFrame:
    """``doc_id`` as long and ``text`` as string, nothing else: other columns can't clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column without copying the text; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def slices(offsets: np.ndarray, most: int):
    """(first, last) document ranges whose bytes stay near ``most``; at least one document each."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last
        first = last


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), in place on a copy."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
