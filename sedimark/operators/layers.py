"""Layered settings as rows (setting, precedence, value): who wins, and what was overridden."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolved(rows: DataFrame, keys: list[str], precedence: str, value: str) -> DataFrame:
    """The value of the highest precedence for each setting, and how many it overrode."""
    return rows.groupBy(*keys).agg(F.max_by(value, precedence).alias(value), F.max(precedence).alias(precedence), (F.count("*") - 1).alias("shadowed"))


def shadowed(rows: DataFrame, keys: list[str], precedence: str, value: str) -> DataFrame:
    """Every overridden value, in the order in which layers were applied, with the value that replaced it.

    The layers of one setting are as many as there are sources, so a window over them is small.
    """
    by = Window.partitionBy(*keys).orderBy(precedence)
    ranked = rows.withColumn("step", F.row_number().over(by)).withColumn("replaced_by", F.lead(value).over(by))
    return ranked.where("replaced_by is not null").select(*keys, "step", precedence, value, "replaced_by")


def explained(effective: DataFrame, history: DataFrame, setting: str) -> DataFrame:
    """One setting's value beside each of its overridden values."""
    return effective.where(F.col("setting") == setting).join(history.where(F.col("setting") == setting).select("setting", "step", F.col("value").alias("overridden")), "setting", "left")
