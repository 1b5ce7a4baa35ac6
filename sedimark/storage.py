"""The shared scratch folder: tables written there end a lineage and survive lost executors."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Deletes the shuffle files of a query when it has ended.
_CLEANS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BROADCASTS = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")


def work_root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one only where one machine does all."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isEmpty():
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sedimark-"))
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
    return known.get().rstrip("/")


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one; it goes when the driver ends, if not before."""
    path = f"{work_root(spark)}/{label}-{uuid.uuid4().hex}"
    files, where = _place(spark, path)
    files.mkdirs(where)
    files.deleteOnExit(where)
    return path


@contextlib.contextmanager
def _holding(spark: SparkSession, value: str, *names: str):
    before = [(name, spark.conf.get(name, None)) for name in names]
    try:
        for name in names:
            spark.conf.set(name, value)
        yield
    finally:
        for name, old in before:
            spark.conf.unset(name) if old is None else spark.conf.set(name, old)


def shuffles_cleaned(spark: SparkSession):
    """The shuffle files of a query are deleted as soon as it has ended; only for tables that no later query takes up again."""
    return _holding(spark, "true", _CLEANS)


def joined_by_shuffles(spark: SparkSession):
    """No join is planned as a broadcast, which the driver would gather and build.

    The planner judges tables by their compressed files; paths and hashes take many times that in memory.
    """
    return _holding(spark, "-1", *_BROADCASTS)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; its lineage ends there.

    Nothing reads the shuffles behind it again, so Spark deletes them as soon as the table is written.  A
    table that can't be written is deleted at once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    try:
        with shuffles_cleaned(spark):
            df.write.mode("overwrite").parquet(path)
    except BaseException:
        files, where = _place(spark, path)
        files.delete(where, True)
        raise
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that nothing will read again."""
    for table in tables:
        if path := getattr(table, "_scratch", None):
            files, where = _place(table.sparkSession, path)
            files.delete(where, True)
            del table._scratch
