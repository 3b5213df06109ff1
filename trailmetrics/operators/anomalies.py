"""Detectors of redundant steps, retry loops, bottlenecks and model deviations.

``members`` maps workflow_id to its cluster (column ``key``), with the trace
totals ``success`` and ``total_duration_ms``.  All detectors return the columns
key, pattern_type, description, tool_name, severity, evidence.  One report per
cluster and tool is kept by ``min_by``, which combines on the map side, so a tool
used in every run is no hot group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmetrics.functions.sequences import has_loop
from trailmetrics.operators.graphs import AlignedRuns, model_deviations
from trailmetrics.operators.ordering import step_block, with_borrowed_rows, with_next

TRACE_ORDER = ["step_number", "timestamp", "event_id"]


def _report(
    rows: DataFrame, key: str, kind: str, severity: str, description: Column,
    tool: Column, evidence: dict[str, Column],
) -> DataFrame:
    entries = [x for name, value in evidence.items() for x in (F.lit(name), value.cast("string"))]
    return rows.select(
        F.col(key), F.lit(kind).alias("pattern_type"), description.alias("description"),
        tool.alias("tool_name"), F.lit(severity).alias("severity"),
        F.create_map(*entries).alias("evidence"),
    )


def redundant_steps(
    event_logs: DataFrame, members: DataFrame, key: str = "task_cluster", min_calls: int = 2
) -> DataFrame:
    """Tools called at least ``min_calls`` times in one run; the first run (by id) per tool."""
    first = (
        event_logs.filter(F.col("tool_name").isNotNull())
        .groupBy("workflow_id", "tool_name")
        .agg(F.count("*").alias("calls"))
        .filter(F.col("calls") >= min_calls)
        .join(members.select("workflow_id", key), "workflow_id")
        .groupBy(key, "tool_name")
        .agg(F.min(F.struct("workflow_id", "calls")).alias("r"))
    )
    text = F.format_string(
        "Tool '%s' called %d times in workflow %s (expected 1)",
        F.col("tool_name"), F.col("r.calls"), F.col("r.workflow_id"),
    )
    return _report(
        first, key, "redundant_step", "medium", text, F.col("tool_name"),
        {"count": F.col("r.calls"), "workflow_id": F.col("r.workflow_id")},
    )


def retries(event_logs: DataFrame) -> DataFrame:
    """Failed tool calls directly followed (over all events) by the same tool."""
    rows = event_logs.select("workflow_id", *TRACE_ORDER, "tool_name", "status")
    return with_next(
        rows, ["workflow_id"], step_block(), TRACE_ORDER, ["tool_name", "step_number"]
    ).filter(
        (F.col("status") == "failure") & (F.col("tool_name") == F.col("next.tool_name"))
    )


def retry_loops(event_logs: DataFrame, members: DataFrame, key: str = "task_cluster") -> DataFrame:
    first = (
        retries(event_logs)
        .join(members.select("workflow_id", key), "workflow_id")
        .groupBy(key, "tool_name")
        .agg(
            F.min(F.struct("workflow_id", *TRACE_ORDER, F.col("next.step_number").alias("retry_step")))
            .alias("r")
        )
    )
    text = F.format_string(
        "Tool '%s' retried after failure in workflow %s", F.col("tool_name"), F.col("r.workflow_id")
    )
    return _report(
        first, key, "retry_loop", "high", text, F.col("tool_name"),
        {
            "failure_step": F.col("r.step_number"), "retry_step": F.col("r.retry_step"),
            "workflow_id": F.col("r.workflow_id"),
        },
    )


def bottleneck_tools(
    event_logs: DataFrame, members: DataFrame, key: str = "task_cluster", threshold: float = 0.40
) -> DataFrame:
    """Tools whose mean duration is at least ``threshold`` of the mean run duration.

    Runs with no positive duration are left out of both means.
    """
    timed = members.filter(F.col("total_duration_ms") > 0)
    totals = timed.groupBy(key).agg(F.avg("total_duration_ms").alias("avg_total"))
    per_tool = (
        event_logs.filter(F.col("tool_name").isNotNull())
        .groupBy("workflow_id", "tool_name")
        .agg(F.sum("duration_ms").alias("ms"), F.count("*").alias("n"))
        .join(timed.select("workflow_id", key), "workflow_id")
        .groupBy(key, "tool_name")
        .agg((F.sum("ms") / F.sum("n")).alias("avg_ms"))
    )
    share = F.col("avg_ms") / F.col("avg_total")
    slow = per_tool.join(totals, key).withColumn("share", share).filter(share >= threshold)
    # Rounding to 6 digits first takes off the noise that the order of a sum leaves.
    avg_ms, avg_total, part = [F.round(c, 6) for c in ("avg_ms", "avg_total", "share")]
    text = F.format_string(
        "Tool '%s' avg %.0fms (%.0f%% of total %.0fms)",
        F.col("tool_name"), F.bround(avg_ms, 0), F.bround(F.round(F.col("share") * 100, 6), 0), F.bround(avg_total, 0),
    )
    return _report(
        slow, key, "bottleneck", "high", text, F.col("tool_name"),
        {
            "avg_duration_ms": F.round(avg_ms, 1), "pct_of_total": F.round(part, 3),
            "avg_total_ms": F.round(avg_total, 1),
        },
    )


def conformance_deviations(
    event_logs: DataFrame, members: DataFrame, model: DataFrame, key: str = "task_cluster",
    aligned: AlignedRuns | None = None,
) -> DataFrame:
    text = F.format_string(
        "Trace deviates from optimal model: %d missing moves, %d left-over moves",
        F.col("missing"), F.col("remaining"),
    )
    return _report(
        model_deviations(event_logs, members, model, key, aligned), key, "conformance_deviation", "medium",
        text, F.lit(None).cast("string"),
        {
            "missing": F.col("missing"), "remaining": F.col("remaining"),
            "workflow_id": F.col("workflow_id"),
        },
    )


def detect_patterns(
    event_logs: DataFrame, members: DataFrame, model: DataFrame | None = None,
    key: str = "task_cluster", min_calls: int = 2, bottleneck_share: float = 0.40,
    aligned: AlignedRuns | None = None,
) -> DataFrame:
    """All detectors together; model deviations only where a model is given (with the alignments
    of ``align_runs``, if they are there already)."""
    found = (
        redundant_steps(event_logs, members, key, min_calls)
        .unionByName(retry_loops(event_logs, members, key))
        .unionByName(bottleneck_tools(event_logs, members, key, bottleneck_share))
    )
    if model is not None:
        found = found.unionByName(conformance_deviations(event_logs, members, model, key, aligned))
    return found


def loop_steps(
    event_logs: DataFrame, width: int = 6, threshold: int = 4
) -> DataFrame:
    """Steps at which some tool makes up ``threshold`` of the last ``width`` tool calls.

    Windows run per block of steps; a block borrows the last ``width - 1`` calls
    before it, so a very long run is looked at by many tasks.
    """
    rows = (
        event_logs.filter(F.col("tool_name").isNotNull())
        .select("workflow_id", *TRACE_ORDER, "tool_name")
        .withColumn("block", step_block())
    )
    together = with_borrowed_rows(rows, ["workflow_id"], "block", TRACE_ORDER, ["tool_name"], width)
    frame = (
        Window.partitionBy("workflow_id", "block").orderBy(*TRACE_ORDER).rowsBetween(-(width - 1), 0)
    )
    return (
        together.withColumn("recent", F.collect_list("tool_name").over(frame))
        .filter("own")
        .filter(has_loop(F.col("recent"), threshold))
        .select("workflow_id", "step_number", "tool_name", F.array_join("recent", ">").alias("recent"))
    )
