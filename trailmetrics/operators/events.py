"""Building blocks over the event log used by every query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmetrics.functions.measures import (
    is_mode_event, is_terminal, is_tool_call, success_value,
)
from trailmetrics.sources.schemas import COMPLETE, GUIDED


def tool_calls(event_logs: DataFrame) -> DataFrame:
    return event_logs.filter(is_tool_call())


def terminal_events(event_logs: DataFrame) -> DataFrame:
    return event_logs.filter(is_terminal())


def mode_map(event_logs: DataFrame) -> DataFrame:
    """is_guided (0/1) per workflow that has a mode event."""
    return (
        event_logs.filter(is_mode_event())
        .groupBy("workflow_id")
        .agg(F.max(F.when(F.col("activity") == GUIDED, 1).otherwise(0)).alias("is_guided"))
    )


def cost_map(event_logs: DataFrame) -> DataFrame:
    return event_logs.groupBy("workflow_id").agg(F.sum("cost_usd").alias("total_cost_usd"))


def guided_ids(event_logs: DataFrame) -> DataFrame:
    return event_logs.filter(F.col("activity") == GUIDED).select("workflow_id").distinct()


def terminal_with_mode(event_logs: DataFrame) -> DataFrame:
    """Terminal events with their mode flag (no mode event = exploration)."""
    return (
        terminal_events(event_logs)
        .join(mode_map(event_logs), "workflow_id", "left")
        .withColumn("is_guided", F.coalesce("is_guided", F.lit(0)))
    )


def workflow_rollup(event_logs: DataFrame) -> DataFrame:
    """One row per workflow holding everything the mode reports add up.

    One scan and one shuffle of partial aggregates replace the mode map, the cost
    map and the terminal scan; a workflow with very many rows shrinks to one row
    per map task before the shuffle.
    """
    end = is_terminal()
    return event_logs.groupBy("workflow_id").agg(
        F.max(F.when(is_mode_event(), F.when(F.col("activity") == GUIDED, 1).otherwise(0)))
        .alias("mode_flag"),
        F.sum("cost_usd").alias("total_cost_usd"),
        F.count("*").alias("n_events"),
        F.count(F.when(end, 1)).alias("n_terminal"),
        F.count(F.when(end, F.col("duration_ms"))).alias("n_duration"),
        F.sum(F.when(end, F.col("duration_ms"))).alias("sum_duration_ms"),
        F.max(F.when(end, F.col("duration_ms"))).alias("max_duration_ms"),
        F.sum(F.when(end, F.col("step_number"))).alias("sum_steps"),
        F.max(F.when(end, F.col("step_number"))).alias("max_steps"),
        F.max(F.when(end, F.col("status"))).alias("last_status"),
        F.sum(F.when(end, success_value())).alias("n_success"),
        F.count(F.when(F.col("activity") == COMPLETE, 1)).alias("n_complete"),
    ).withColumn("is_guided", F.coalesce("mode_flag", F.lit(0)))


def tool_stats(calls: DataFrame) -> DataFrame:
    """Calls, mean duration, cost and calls per workflow for each tool.

    Rows are first combined per (tool, workflow); the distinct count of workflows
    then is a plain count, and a dominant tool is spread by workflow.
    """
    per_workflow = calls.groupBy("tool_name", "workflow_id").agg(
        F.count("*").alias("n"),
        F.count("duration_ms").alias("n_ms"),
        F.sum("duration_ms").alias("ms"),
        F.sum("cost_usd").alias("cost"),
    )
    return per_workflow.groupBy("tool_name").agg(
        F.sum("n").alias("call_count"),
        (F.sum("ms") / F.nullif(F.sum("n_ms"), F.lit(0))).alias("avg_duration_ms"),
        F.sum("cost").alias("total_cost_usd"),
        (F.sum("n") / F.count("workflow_id")).alias("avg_calls_per_workflow"),
    )
