"""Trace reconstruction and sequence-level aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmetrics.functions.measures import is_terminal, success_value
from trailmetrics.operators.ordering import hour_block, step_block
from trailmetrics.sources.schemas import COMPLETE, GUIDED


def build_traces(event_logs: DataFrame, extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per workflow: ordered tools, totals and outcome.

    ``success`` needs a ``workflow:complete`` with status success.  The duration is
    that of the first completion with a positive duration, else the sum over the
    tool calls; the duration of a failure event is never used.

    Sequences are sorted inside blocks of steps first and joined up afterwards, so
    sorting a very long run is shared by many tasks.
    """
    keys = ["workflow_id", *extra_keys]
    tool = F.col("tool_name").isNotNull()
    done = F.col("activity") == COMPLETE
    place = F.struct("step_number", "timestamp", "event_id")
    blocks = event_logs.withColumn("block", step_block()).groupBy(*keys, "block").agg(
        F.array_sort(
            F.collect_list(F.when(tool, F.struct("step_number", "timestamp", "event_id", "tool_name")))
        ).alias("calls"),
        F.sum(F.when(tool, F.col("duration_ms"))).alias("tool_ms"),
        F.min(F.when(done & (F.col("duration_ms") > 0), F.struct(place.alias("at"), "duration_ms")))
        .alias("first_end"),
        F.sum("cost_usd").alias("cost"),
        F.max(done & (F.col("status") == "success")).alias("success"),
        F.max(done).alias("completed"),
        F.max(F.col("activity") == GUIDED).alias("is_guided"),
        F.sum(F.when(is_terminal(), 1).otherwise(0)).alias("n_terminal"),
        F.min("timestamp").alias("first_timestamp"),
        F.max("timestamp").alias("last_timestamp"),
    )
    parts = blocks.withColumn("tools", F.col("calls.tool_name")).groupBy(*keys).agg(
        F.flatten(
            F.transform(
                F.array_sort(F.collect_list(F.struct("block", "tools"))), lambda b: b["tools"]
            )
        ).alias("tool_sequence"),
        F.coalesce(
            F.min("first_end")["duration_ms"], F.sum("tool_ms"), F.lit(0.0)
        ).alias("total_duration_ms"),
        F.sum("cost").alias("total_cost_usd"),
        F.max("success").alias("success"),
        F.max("completed").alias("completed"),
        F.max("is_guided").alias("is_guided"),
        F.sum("n_terminal").alias("n_terminal"),
        F.min("first_timestamp").alias("first_timestamp"),
        F.max("last_timestamp").alias("last_timestamp"),
    )
    return parts.withColumn("total_steps", F.size("tool_sequence"))


def ordered_sequences(calls: DataFrame, by_time: bool = False) -> DataFrame:
    """Tool sequence per workflow, in step order or (the variants report) in time order.

    Sorted inside blocks first, like ``build_traces``.
    """
    order = ["timestamp", "step_number"] if by_time else ["step_number", "timestamp"]
    block = hour_block() if by_time else step_block()
    sorted_blocks = calls.withColumn("block", block).groupBy("workflow_id", "block").agg(
        F.array_sort(F.collect_list(F.struct(*order, "event_id", "tool_name")))["tool_name"].alias("tools")
    )
    return sorted_blocks.groupBy("workflow_id").agg(
        F.flatten(
            F.transform(F.array_sort(F.collect_list(F.struct("block", "tools"))), lambda b: b["tools"])
        ).alias("tool_sequence")
    )


def variants(traces: DataFrame, key: str) -> DataFrame:
    """Distinct sequences of a group with additive totals over their traces."""
    return traces.groupBy(key, "tool_sequence").agg(
        F.count("*").alias("n"),
        F.sum(F.col("total_duration_ms").cast("decimal(28,6)")).alias("sum_ms"),
        F.sum("total_cost_usd").alias("sum_cost"),
        F.sum("total_steps").alias("sum_steps"),
        F.sum(F.when(F.col("success"), 1).otherwise(0)).alias("n_success"),
    )


def most_frequent_sequence(traces: DataFrame, *keys: str) -> DataFrame:
    """Most common non-empty sequence per group; ties go to the smallest sequence."""
    return (
        traces.filter(F.size("tool_sequence") > 0)
        .groupBy(*keys, "tool_sequence")
        .agg(F.count("*").alias("n"))
        .groupBy(*keys)
        .agg(F.min_by("tool_sequence", F.struct(-F.col("n"), F.col("tool_sequence"))).alias("tool_sequence"))
    )


def common_prefix_length(sequences: DataFrame, key: str, column: str = "tool_sequence") -> DataFrame:
    """Length of the longest common prefix of all sequences of a group."""
    sizes = sequences.groupBy(key).agg(
        F.count("*").alias("n_seq"), F.min(F.size(column)).alias("shortest")
    )
    agreeing = (
        sequences.select(key, F.posexplode(column).alias("pos", "tool"))
        .groupBy(key, "pos")
        .agg(F.count("*").alias("n"), F.min("tool").alias("lo"), F.max("tool").alias("hi"))
        .join(sizes, key)
        .filter((F.col("n") < F.col("n_seq")) | (F.col("lo") != F.col("hi")))
        .groupBy(key)
        .agg(F.min("pos").alias("first_difference"))
    )
    return sizes.join(agreeing, key, "left").select(
        key, "n_seq", F.coalesce("first_difference", "shortest").alias("prefix_length")
    )


def trace_totals(event_logs: DataFrame) -> DataFrame:
    """Duration, cost, tokens and tool steps per workflow, with its overall status."""
    tool = F.col("tool_name").isNotNull()
    return event_logs.groupBy("workflow_id").agg(
        F.sum("duration_ms").alias("total_duration_ms"),
        F.sum("cost_usd").cast("double").alias("total_cost_usd"),
        F.sum(F.col("llm_prompt_tokens") + F.col("llm_completion_tokens")).alias("total_tokens"),
        F.count(F.when(tool, 1)).alias("tool_steps"),
        F.bool_or(F.col("status") == "failure").alias("any_failure"),
        F.bool_or(F.col("status") == "timeout").alias("any_timeout"),
        F.max(is_terminal()).alias("ended"),
        F.avg(success_value()).alias("step_success_rate"),
    )
