"""Smaller reports: trace pages, live views, round summaries, path edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmetrics.functions.measures import mode_label, status_of_run, stroke_width
from trailmetrics.functions.vectors import cosine_similarity
from trailmetrics.operators.events import terminal_with_mode
from trailmetrics.operators.graphs import optimal_edges, transitions
from trailmetrics.operators.traces import trace_totals


def trace_headers(event_logs: DataFrame) -> DataFrame:
    """Totals and both status rules per workflow."""
    totals = trace_totals(event_logs)
    return totals.select(
        "workflow_id", "total_duration_ms", "total_cost_usd", "total_tokens", "tool_steps",
        status_of_run(F.col("any_failure"), F.col("any_timeout"), "timeout").alias("overall_status"),
        status_of_run(F.col("any_failure"), ~F.col("ended"), "in_progress").alias("live_status"),
    )


def mode_by_role(event_logs: DataFrame) -> DataFrame:
    """The trace page's rule: guided if the first event's agent role mentions it."""
    first = F.min_by("agent_role", F.struct("step_number", "timestamp", "event_id"))
    return event_logs.groupBy("workflow_id").agg(first.alias("first_role")).select(
        "workflow_id", mode_label(F.lower("first_role").contains("guided")).alias("mode")
    )


def merged_workflow_list(active: DataFrame, finished: DataFrame) -> DataFrame:
    """Active and finished workflows in one list, active first, each id once."""
    columns = ["workflow_id", "status", "steps", "timestamp"]
    rest = finished.join(active.select("workflow_id"), "workflow_id", "left_anti")
    return active.select(F.lit(0).alias("section"), *columns).unionByName(
        rest.select(F.lit(1).alias("section"), *columns)
    )


def merged_events(stored: DataFrame, live: DataFrame) -> DataFrame:
    """Stored events plus live ones that are not stored yet, each event_id once."""
    fresh = live.dropDuplicates(["event_id"]).join(stored.select("event_id"), "event_id", "left_anti")
    return stored.unionByName(fresh.select(*stored.columns))


def round_summary(event_logs: DataFrame, round_of) -> DataFrame:
    """Runs, successes, mean steps and duration, tokens per round and mode; the rows
    with NULL mode or round are the subtotals."""
    tokens = event_logs.groupBy("workflow_id").agg(
        F.sum(F.col("llm_prompt_tokens") + F.col("llm_completion_tokens")).alias("tokens")
    )
    runs = terminal_with_mode(event_logs).join(tokens, "workflow_id").select(
        round_of.alias("round"), mode_label(F.col("is_guided") == 1).alias("mode"),
        "status", "step_number", "duration_ms", "tokens",
    )
    return runs.rollup("round", "mode").agg(
        F.count("*").alias("runs"),
        F.count(F.when(F.col("status") == "success", 1)).alias("successes"),
        F.avg("step_number").alias("avg_steps"), F.avg("duration_ms").alias("avg_duration_ms"),
        F.sum("tokens").alias("tokens"),
    )


def drawn_edges(event_logs: DataFrame, paths: DataFrame) -> DataFrame:
    """Transitions without self loops, with line width and whether a stored path uses them.

    The heaviest edge is found over the per-tool-pair table.
    """
    edges = transitions(event_logs)
    heaviest = edges.agg(F.max("weight").alias("heaviest")).withColumn("one", F.lit(1))
    optimal = optimal_edges(paths).withColumn("on_path", F.lit(True))
    return (
        edges.filter(F.col("source") != F.col("target"))
        .withColumn("one", F.lit(1)).join(F.broadcast(heaviest), "one")  # one row
        .join(optimal, ["source", "target"], "left")
        .select(
            "source", "target", "weight",
            stroke_width(F.col("weight"), F.col("heaviest")).alias("width"),
            F.coalesce("on_path", F.lit(False)).alias("on_path"),
        )
    )


def tool_differences(traces: DataFrame, optimal: DataFrame, key: str = "task_cluster") -> DataFrame:
    """Tools of a run that its cluster's path lacks, and whether both use the same set."""
    best = optimal.select(key, F.col("tool_sequence").alias("best"))
    return traces.join(best, key).select(
        "workflow_id",
        F.array_sort(F.array_except("tool_sequence", "best")).alias("extra_tools"),
        (F.array_sort(F.array_distinct("tool_sequence")) == F.array_sort(F.array_distinct("best")))
        .alias("same_tools"),
    )


def pair_similarity(pairs: DataFrame) -> DataFrame:
    """Cosine similarity of two vector columns ``a`` and ``b``."""
    return pairs.withColumn("similarity", cosine_similarity(F.col("a"), F.col("b")))
