"""Suggestions from detected patterns and from comparing runs with the optimal path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmetrics.functions.sequences import same_tools_other_order

COLUMNS = ["suggestion_type", "message", "priority", "affected_tools", "estimated_saving_ms"]


def from_patterns(patterns: DataFrame, key: str = "task_cluster") -> DataFrame:
    """Type and priority by pattern; the saving is the evidence's mean duration."""
    kind = F.col("pattern_type")
    return patterns.select(
        key,
        F.when(kind == "redundant_step", "skip_step")
        .when(kind == "retry_loop", "fix_reliability")
        .when(kind == "bottleneck", "optimize_step")
        .when(kind == "conformance_deviation", "remove_step")
        .otherwise("general").alias("suggestion_type"),
        F.col("description").alias("message"),
        F.when(kind.isin("redundant_step", "retry_loop"), "high")
        .when(kind.isin("bottleneck", "conformance_deviation"), "medium")
        .otherwise("low").alias("priority"),
        F.array_compact(F.array("tool_name")).alias("affected_tools"),
        F.coalesce(F.try_element_at("evidence", F.lit("avg_duration_ms")).cast("double"), F.lit(0.0))
        .alias("estimated_saving_ms"),
    )


def reorderings(traces: DataFrame, optimal: DataFrame, key: str = "task_cluster") -> DataFrame:
    """First run (by id) of a cluster with the optimal path's tools in another order."""
    best = optimal.select(
        key, F.col("tool_sequence").alias("best"), F.col("avg_duration_ms").alias("best_ms")
    )
    first = (
        traces.join(best, key)
        .filter(
            (F.size("tool_sequence") > 0) & (F.size("best") > 0)
            & same_tools_other_order(F.col("tool_sequence"), F.col("best"))
        )
        .groupBy(key)
        .agg(
            F.min_by(
                F.struct("workflow_id", "tool_sequence", "total_duration_ms", "best", "best_ms"),
                "workflow_id",
            ).alias("r")
        )
        .select(key, "r.*")
    )
    arrow = " → "
    return first.select(
        key, F.lit("reorder").alias("suggestion_type"),
        F.concat(
            F.lit("Reorder tools in workflow "), "workflow_id", F.lit(": current ["),
            F.array_join("tool_sequence", arrow), F.lit("] → optimal ["),
            F.array_join("best", arrow), F.lit("]"),
        ).alias("message"),
        F.lit("medium").alias("priority"),
        F.array_sort(F.array_distinct("tool_sequence")).alias("affected_tools"),
        F.greatest(F.lit(0.0), F.col("total_duration_ms") - F.col("best_ms")).alias("estimated_saving_ms"),
    )


def skippable_steps(
    event_logs: DataFrame, members: DataFrame, optimal: DataFrame, patterns: DataFrame,
    key: str = "task_cluster",
) -> DataFrame:
    """Tools outside the optimal path, one per tool and not already to be skipped.

    The saving is the tool's mean duration in the first run (by id) that has it.
    """
    path_tools = optimal.filter(F.size("tool_sequence") > 0).select(
        key, F.explode("tool_sequence").alias("tool_name"))
    done = patterns.filter(F.col("pattern_type") == "redundant_step").select(key, "tool_name")
    return (
        event_logs.filter(F.col("tool_name").isNotNull())
        .groupBy("workflow_id", "tool_name")
        .agg(F.avg("duration_ms").alias("ms"))
        .join(members.select("workflow_id", key), "workflow_id")
        .join(path_tools.select(key).distinct(), key, "left_semi")
        .groupBy(key, "tool_name")
        .agg(F.min_by("ms", "workflow_id").alias("estimated_saving_ms"))
        .join(path_tools, [key, "tool_name"], "left_anti")
        .join(done, [key, "tool_name"], "left_anti")
        .select(
            key, F.lit("skip_step").alias("suggestion_type"),
            F.concat(F.lit("Tool '"), "tool_name", F.lit("' not in optimal path — consider removing"))
            .alias("message"),
            F.lit("medium").alias("priority"), F.array("tool_name").alias("affected_tools"),
            "estimated_saving_ms",
        )
    )


def generate_suggestions(
    event_logs: DataFrame, traces: DataFrame, optimal: DataFrame, patterns: DataFrame,
    key: str = "task_cluster",
) -> DataFrame:
    return (
        from_patterns(patterns, key)
        .unionByName(reorderings(traces, optimal, key))
        .unionByName(skippable_steps(event_logs, traces, optimal, patterns, key))
    )
