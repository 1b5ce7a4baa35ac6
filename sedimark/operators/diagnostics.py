"""Diagnostics as rows: coalescing, coverage and the class of an outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def from_issues(issues: DataFrame, any_accepted: bool) -> DataFrame:
    """Discovery issues as diagnostics: warnings that degrade coverage, or errors if no input was valid."""
    skipped = F.col("kind") == "input_excluded_by_policy"
    return issues.select(
        F.when(F.lit(any_accepted), F.lit("partial_inventory")).otherwise("invalid_command_input").alias("code"),
        F.lit("warning" if any_accepted else "error").alias("severity"),
        F.when(F.lit(any_accepted) & ~skipped, "observation").otherwise("input").alias("classification"),
        F.lit("degrades_coverage" if any_accepted else "blocks_command").alias("impact"),
        "message",
        "path",
        "os_error_kind",
    )


def coalesce(rows: DataFrame, keys: list[str], count: str = "count") -> DataFrame:
    """Equal rows as one whose counts add up (a missing count is one); a single row keeps its own."""
    return rows.groupBy(*keys).agg(F.when(F.count("*") > 1, F.sum(F.coalesce(F.col(count), F.lit(1)))).otherwise(F.max(count)).alias(count))


def coverage() -> Column:
    """An aggregate: partial if any diagnostic degrades coverage."""
    return F.when(F.coalesce(F.bool_or(F.col("impact") == "degrades_coverage"), F.lit(False)), "partial").otherwise("complete")


def outcome_class(has_output: Column | None = None) -> Column:
    """An aggregate over code, classification and impact: the first class of the precedence that holds."""

    def some(test: Column) -> Column:
        return F.coalesce(F.bool_or(test), F.lit(False))

    def blocked(*kinds: str) -> Column:
        return some((F.col("impact") == "blocks_command") & F.col("classification").isin(*kinds))

    partial = F.lit("partial_success") if has_output is None else F.when(F.coalesce(F.bool_or(has_output), F.lit(False)), "partial_success").otherwise("internal_failure")
    return (
        F.when(some(F.col("code") == "operation_interrupted"), "interrupted")
        .when(some(F.col("code") == "operation_terminated"), "terminated")
        .when(blocked("internal", "artifact"), "internal_failure")
        .when(blocked("state"), "stale_state")
        .when(blocked("capability"), "capability_unavailable")
        .when(blocked("input"), "invalid_input")
        .when(some(F.col("impact") == "degrades_coverage"), partial)
        .otherwise("success")
    )
