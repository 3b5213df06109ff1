"""Dashboard queries over the whole event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmetrics.functions.measures import (
    is_terminal, mode_label, percent_improvement, ratio, success_value,
)
from trailmetrics.operators import paging
from trailmetrics.operators.events import (
    guided_ids, terminal_events, terminal_with_mode, tool_calls, tool_stats,
    workflow_rollup,
)
from trailmetrics.operators.graphs import graph_nodes, transitions
from trailmetrics.operators.ordering import step_block, trailing_mean
from trailmetrics.sources.schemas import COMPLETE, FAIL, START


def analytics_summary(event_logs: DataFrame) -> DataFrame:
    """Totals over all events; means over terminal events.

    A mean that is truly 0 stays 0.
    """
    return workflow_rollup(event_logs).agg(
        F.count("*").alias("total_workflows"),
        F.sum("n_events").alias("total_events"),
        ratio(F.sum("sum_duration_ms"), F.sum("n_duration")).alias("avg_duration_ms"),
        ratio(F.sum("sum_steps"), F.sum("n_terminal")).alias("avg_steps"),
        ratio(F.sum("n_success"), F.sum("n_terminal")).alias("success_rate"),
    )


def top_tools(event_logs: DataFrame, limit: int = 10) -> DataFrame:
    """Most called tools over any event with a tool name."""
    return (
        event_logs.filter(F.col("tool_name").isNotNull())
        .groupBy("tool_name")
        .agg(F.count("*").alias("call_count"), F.avg("duration_ms").alias("avg_duration_ms"))
        .orderBy(F.desc("call_count"), "tool_name")
        .limit(limit)
    )


def workflow_trace(event_logs: DataFrame, embeddings: DataFrame, workflow_id: str) -> DataFrame:
    """Events of one workflow in trace order with its task description."""
    described = embeddings.filter(F.col("workflow_id") == workflow_id).select(
        "workflow_id", "task_description"
    )
    return (
        event_logs.filter(F.col("workflow_id") == workflow_id)
        .join(described, "workflow_id", "left")
        .orderBy("step_number", "timestamp")
    )


def list_workflows(
    event_logs: DataFrame, embeddings: DataFrame, limit: int = 50, offset: int = 0
) -> DataFrame:
    """One page (1..500 rows) of finished workflows, newest first.

    The page is cut before description and mode are looked up, so only its rows
    are joined.
    """
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must be 1..500 and offset must not be negative")
    page = finished(event_logs).orderBy(*newest()).offset(offset).limit(limit)
    return described_page(event_logs, embeddings, page)


def list_workflows_far(
    event_logs: DataFrame, embeddings: DataFrame, limit: int = 50, offset: int = 0
) -> DataFrame:
    """The same page where the offset is large: only the ranges that hold it are sorted."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be 1..500")
    return described_page(event_logs, embeddings, paging.page(finished(event_logs), newest(), offset, limit))


def newest() -> list[Column]:
    return [F.desc("timestamp"), F.col("workflow_id")]


def finished(event_logs: DataFrame) -> DataFrame:
    return terminal_events(event_logs).select(
        "workflow_id", "status", "duration_ms", F.col("step_number").alias("steps"), "timestamp")


def described_page(event_logs: DataFrame, embeddings: DataFrame, page: DataFrame) -> DataFrame:
    """Task description and mode of the few workflows of a page."""
    ids = page.select("workflow_id")
    flags = guided_ids(event_logs.join(ids, "workflow_id", "left_semi")).withColumn("g", F.lit(True))
    described = embeddings.join(ids, "workflow_id", "left_semi").select("workflow_id", "task_description")
    return (
        page.join(described, "workflow_id", "left")
        .join(flags, "workflow_id", "left")
        .withColumn("mode", mode_label(F.col("g").isNotNull()))
        .drop("g")
        .orderBy(*newest())
    )


def list_optimal_paths(paths: DataFrame) -> DataFrame:
    return paths.select(
        "task_cluster", "tool_sequence", "avg_duration_ms", "avg_steps", "success_rate",
        "execution_count", "updated_at",
    ).orderBy(F.desc("execution_count"), "task_cluster")


def active_workflow_ids(event_logs: DataFrame) -> DataFrame:
    """Started workflows without a terminal event."""
    state = event_logs.filter(F.col("activity").isin(START, COMPLETE, FAIL))
    return (
        state.groupBy("workflow_id")
        .agg(F.bool_or(F.col("activity") == START).alias("started"), F.bool_or(is_terminal()).alias("ended"))
        .filter("started and not ended")
        .select("workflow_id")
    )


def list_active_workflows(event_logs: DataFrame, embeddings: DataFrame) -> DataFrame:
    active = active_workflow_ids(event_logs)
    return (
        event_logs.join(active, "workflow_id", "left_semi")
        .groupBy("workflow_id")
        .agg(
            F.max("step_number").alias("steps"),
            F.min("timestamp").alias("timestamp"),
            F.bool_or(F.col("activity") == "optimize:guided").alias("is_guided"),
        )
        .join(embeddings.select("workflow_id", "task_description"), "workflow_id", "left")
        .select(
            "workflow_id", "task_description", F.lit("in_progress").alias("status"),
            F.lit(None).cast("double").alias("duration_ms"), "steps", "timestamp", "is_guided",
        )
        .orderBy(F.desc("timestamp"), "workflow_id")
    )


def mode_distribution(event_logs: DataFrame) -> DataFrame:
    rollup = workflow_rollup(event_logs)
    return rollup.agg(
        F.coalesce(F.sum(F.when(F.col("is_guided") == 1, F.col("n_terminal"))), F.lit(0)).alias("guided"),
        F.coalesce(F.sum(F.when(F.col("is_guided") == 0, F.col("n_terminal"))), F.lit(0)).alias("exploration"),
        F.coalesce(F.sum("n_terminal"), F.lit(0)).alias("total"),
    )


def mode_statistics(rollup: DataFrame) -> DataFrame:
    """Means per mode over terminal events, one row, columns exp_* and gui_*."""
    def columns(prefix: str, flag: int) -> list:
        chosen = F.col("is_guided") == flag
        n = F.sum(F.when(chosen, F.col("n_terminal")))
        total = F.sum(F.when(chosen, F.col("total_cost_usd") * F.col("n_terminal")))
        return [
            ratio(F.sum(F.when(chosen, F.col("sum_duration_ms"))),
                  F.sum(F.when(chosen, F.col("n_duration")))).alias(f"{prefix}_avg_duration"),
            ratio(F.sum(F.when(chosen, F.col("sum_steps"))), n).alias(f"{prefix}_avg_steps"),
            ratio(F.sum(F.when(chosen, F.col("n_success"))), n).alias(f"{prefix}_success_rate"),
            F.coalesce(n, F.lit(0)).alias(f"{prefix}_count"),
            ratio(total, n).alias(f"{prefix}_avg_cost"),
        ]

    return rollup.agg(*columns("exp", 0), *columns("gui", 1))


def mode_comparison(event_logs: DataFrame) -> DataFrame:
    return mode_statistics(workflow_rollup(event_logs))


def timeline(event_logs: DataFrame) -> DataFrame:
    """Per day of the terminal event: runs, mean duration, success and guided share."""
    return (
        terminal_with_mode(event_logs)
        .groupBy(F.to_date("timestamp").alias("date"))
        .agg(
            F.count("*").alias("workflows"),
            F.avg("duration_ms").alias("avg_duration_ms"),
            F.avg(success_value()).alias("success_rate"),
            F.avg(F.col("is_guided").cast("double")).alias("guided_pct"),
        )
        .orderBy("date")
    )


def execution_graph_nodes(event_logs: DataFrame) -> DataFrame:
    return graph_nodes(event_logs)


def execution_graph_edges(event_logs: DataFrame) -> DataFrame:
    return transitions(event_logs)


def bottlenecks(event_logs: DataFrame) -> DataFrame:
    return tool_stats(tool_calls(event_logs)).orderBy(
        F.desc_nulls_last("avg_duration_ms"), "tool_name"
    )


def savings(event_logs: DataFrame) -> DataFrame:
    """Time and cost saved by guided runs.

    Runs without a terminal event take part: their missing status counts as a
    failure, and they count in ``guided_count`` and in the mean cost.
    """
    flat = workflow_rollup(event_logs)
    ok = F.when(F.col("last_status") == "success", 1.0).otherwise(0.0)

    def mean(column, flag):
        return F.coalesce(F.avg(F.when(F.col("is_guided") == flag, column)).cast("double"), F.lit(0.0))

    stats = flat.agg(
        mean(F.col("max_duration_ms"), 0).alias("exp_ms"), mean(F.col("max_duration_ms"), 1).alias("gui_ms"),
        mean(F.col("max_steps"), 0).alias("exp_steps"), mean(F.col("max_steps"), 1).alias("gui_steps"),
        mean(ok, 0).alias("exp_ok"), mean(ok, 1).alias("gui_ok"),
        mean(F.col("total_cost_usd").cast("double"), 0).alias("exp_cost"),
        mean(F.col("total_cost_usd").cast("double"), 1).alias("gui_cost"),
        F.count(F.when(F.col("is_guided") == 1, 1)).alias("guided_count"),
    )
    return stats.select(
        ((F.col("exp_ms") - F.col("gui_ms")) * F.col("guided_count")).alias("time_saved_ms"),
        ((F.col("exp_cost") - F.col("gui_cost")) * F.col("guided_count")).alias("cost_saved_usd"),
        percent_improvement(F.col("exp_ms"), F.col("gui_ms")).alias("pct_duration_improvement"),
        percent_improvement(F.col("exp_steps"), F.col("gui_steps")).alias("pct_steps_improvement"),
        percent_improvement(1 - F.col("exp_ok"), 1 - F.col("gui_ok")).alias("pct_success_improvement"),
        "guided_count",
    )


# --- readiness report -------------------------------------------------------


def guided_readiness(paths: DataFrame, min_executions: int = 30) -> DataFrame:
    missing = F.lit(min_executions) - F.col("execution_count")
    return paths.select(
        "task_cluster", "execution_count", F.round("success_rate", 2).alias("success_rate"),
        F.when(F.col("execution_count") >= min_executions, "GUIDED READY")
        .otherwise(F.concat(F.lit("NEED "), missing, F.lit(" MORE"))).alias("status"),
    ).orderBy("task_cluster")


def workflow_type(description):
    """First matching type of a task description."""
    return (
        F.when(description.ilike("%exchange%"), "exchange")
        .when(description.ilike("%return%"), "return")
        .when(description.ilike("%fulfil%"), "fulfilment")
        .otherwise("other")
    )


def runs_by_type(event_logs: DataFrame, embeddings: DataFrame) -> DataFrame:
    return (
        embeddings.select("workflow_id", workflow_type(F.col("task_description")).alias("workflow_type"))
        .join(terminal_events(event_logs).select("workflow_id", "activity"), "workflow_id")
        .groupBy("workflow_type")
        .agg(
            F.count("*").alias("total_runs"),
            F.count(F.when(F.col("activity") == COMPLETE, 1)).alias("successes"),
            F.count(F.when(F.col("activity") == FAIL, 1)).alias("failures"),
        )
        .orderBy("workflow_type")
    )


def mode_breakdown(event_logs: DataFrame) -> DataFrame:
    return (
        event_logs.filter(F.col("activity").isin("optimize:guided", "optimize:exploration"))
        .groupBy(F.replace("activity", F.lit("optimize:"), F.lit("")).alias("mode"))
        .agg(F.count("*").alias("n"))
    )


# --- derived chart tables ---------------------------------------------------


def performance_over_time(event_logs: DataFrame) -> DataFrame:
    """Duration in seconds of each finished run and the mean of the last three runs
    of its mode."""
    points = terminal_with_mode(event_logs).select(
        mode_label(F.col("is_guided") == 1).alias("mode"), "timestamp", "workflow_id", "event_id",
        (F.coalesce("duration_ms", F.lit(0.0)) / 1000).alias("seconds"),
    )
    return trailing_mean(points, ["mode"], ["timestamp", "event_id"], "seconds", 3, "rolling_avg")


def performance_axes(event_logs: DataFrame) -> DataFrame:
    """Axis extents of the performance chart, mean per mode, first guided run."""
    guided = F.col("is_guided") == 1
    seconds = F.coalesce("duration_ms", F.lit(0.0)) / 1000
    return terminal_with_mode(event_logs).agg(
        F.min("timestamp").alias("x_min"), F.max("timestamp").alias("x_max"),
        F.coalesce(F.ceil(F.max(seconds) * 1.15), F.lit(10)).alias("y_max"),
        F.avg(F.when(~guided, seconds)).alias("exploration_mean"),
        F.avg(F.when(guided, seconds)).alias("guided_mean"),
        F.min(F.when(guided, F.col("timestamp"))).alias("first_guided"),
    )


def cost_leaks(event_logs: DataFrame) -> DataFrame:
    """Tools ranked by total cost (the table has one row per tool)."""
    stats = tool_stats(tool_calls(event_logs)).withColumn("cost", F.col("total_cost_usd").cast("double"))
    by_cost = Window.orderBy(F.desc("cost"), "tool_name")
    top = F.max("cost").over(Window.partitionBy())
    return stats.select(
        F.row_number().over(by_cost).alias("rank"), "tool_name", "cost",
        F.when(top > 0, F.col("cost") / F.nullif(top, F.lit(0.0)) * 100).otherwise(0.0).alias("bar_pct"),
        (F.col("avg_calls_per_workflow") > 2).alias("redundant"),
    )


def bottleneck_quadrant(event_logs: DataFrame) -> DataFrame:
    """Tools at or above the upper median of both calls and mean duration.

    The upper median of n values is the (n/2 + 1)-th smallest, which is
    ``percentile_disc(0.5)`` in descending order.
    """
    stats = tool_stats(tool_calls(event_logs))
    medians = stats.agg(
        F.expr("percentile_disc(0.5) within group (order by call_count desc)").cast("bigint").alias("median_calls"),
        F.expr("percentile_disc(0.5) within group (order by avg_duration_ms desc)").alias("median_ms"),
    )
    packed = medians.select(F.lit(1).alias("one"), "median_calls", "median_ms")
    return stats.withColumn("one", F.lit(1)).join(F.broadcast(packed), "one").select(
        "tool_name", "call_count", "avg_duration_ms", "median_calls", "median_ms",
        ((F.col("call_count") >= F.col("median_calls"))
         & (F.col("avg_duration_ms") >= F.col("median_ms"))).alias("is_hot"),
    )


def trace_timeline(event_logs: DataFrame, min_bar_ms: float = 50.0) -> DataFrame:
    """Start offset and length of each tool bar in its workflow, bars at least 50 ms.

    Offsets add up inside blocks of steps and over the blocks of a workflow.
    """
    order = ["step_number", "timestamp", "event_id"]
    bars = event_logs.filter(F.col("tool_name").isNotNull()).select(
        "workflow_id", *order, "tool_name", "status",
        F.greatest("duration_ms", F.lit(min_bar_ms)).alias("bar_ms"), F.coalesce(step_block(), F.lit(-1)).alias("block"),
    )
    inside = (
        Window.partitionBy("workflow_id", "block").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    over_blocks = (
        Window.partitionBy("workflow_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        bars.groupBy("workflow_id", "block").agg(F.sum("bar_ms").alias("ms"))
        .withColumn("ahead", F.sum("ms").over(over_blocks))
        .filter(F.col("ahead").isNotNull())
        .select("workflow_id", "block", "ahead")
    )
    zero = F.lit(0.0)
    return bars.withColumn("start", F.coalesce(F.sum("bar_ms").over(inside), zero)).join(
        offsets, ["workflow_id", "block"], "left"
    ).select(
        "workflow_id", "step_number", "tool_name", "status",
        (F.col("start") + F.coalesce("ahead", zero)).alias("start_ms"), "bar_ms",
    )


def insights_summary(event_logs: DataFrame) -> DataFrame:
    stats = tool_stats(tool_calls(event_logs))
    return stats.agg(
        F.sum("total_cost_usd").cast("double").alias("total_cost_usd"),
        F.count_if(F.col("avg_calls_per_workflow") > 2).alias("redundant_tools"),
        F.min_by("tool_name", F.struct(-F.col("avg_duration_ms"), F.col("tool_name"))).alias("slowest_tool"),
        F.min_by("tool_name", F.struct(-F.col("call_count"), F.col("tool_name"))).alias("most_called_tool"),
    )


def guided_share(event_logs: DataFrame) -> DataFrame:
    counts = mode_distribution(event_logs)
    return counts.select(
        F.coalesce(ratio(F.col("guided"), F.col("total")) * 100, F.lit(0.0)).alias("guided_pct"),
        F.coalesce(ratio(F.col("exploration"), F.col("total")) * 100, F.lit(0.0)).alias("exploration_pct"),
    )


def comparison_cards(event_logs: DataFrame) -> DataFrame:
    """Seconds, steps, percent and cents per mode for the comparison cards."""
    stats = mode_comparison(event_logs)
    rows = []
    for prefix, label in (("exp", "exploration"), ("gui", "guided")):
        def part(column, factor, digits):
            return F.coalesce(F.round(F.col(f"{prefix}_{column}") * factor, digits), F.lit(0.0))  # noqa: B023
        rows.append(F.struct(
            F.lit(label).alias("mode"),
            part("avg_duration", 0.001, 1).alias("seconds"), part("avg_steps", 1, 1).alias("steps"),
            part("success_rate", 100, 1).alias("success_pct"), part("avg_cost", 100, 2).alias("cents"),
        ))
    return stats.select(F.inline(F.array(*rows)))

