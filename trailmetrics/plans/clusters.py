"""Queries about task clusters (stored paths) and groups of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmetrics.functions import text
from trailmetrics.functions.measures import mode_label, ratio
from trailmetrics.operators import paging
from trailmetrics.operators.events import terminal_events, tool_calls, tool_stats, workflow_rollup
from trailmetrics.operators.graphs import graph_nodes, transitions
from trailmetrics.operators.matching import best_paths
from trailmetrics.operators.similarity import match_paths, nearest_description
from trailmetrics.operators.traces import ordered_sequences
from trailmetrics.plans.dashboards import mode_statistics


def task_clusters(paths: DataFrame, embeddings: DataFrame, threshold: float) -> DataFrame:
    """Stored paths with the closest task description within the threshold."""
    nearest = nearest_description(embeddings, paths, threshold)
    return (
        paths.join(nearest, "path_id", "left")
        .select(
            "path_id", "task_cluster", "tool_sequence", "avg_duration_ms", "avg_steps",
            "success_rate", "execution_count", "updated_at",
            F.col("execution_count").alias("workflow_count"), "task_description",
        )
        .orderBy(F.desc("execution_count"), "task_cluster")
    )


def task_clusters_grouped(paths: DataFrame) -> DataFrame:
    """Paths by parent group; the group's own row gives the total if it exists."""
    parent = text.parent_group(F.col("task_cluster"))
    own = ~text.is_variant(F.col("task_cluster"))
    return (
        paths.groupBy(parent.alias("name"))
        .agg(
            F.coalesce(F.max(F.when(own, F.col("execution_count"))), F.sum("execution_count"))
            .alias("total_workflows"),
            F.count("*").alias("members"),
            F.sum("execution_count").alias("_runs"),
            ratio(
                F.sum(F.col("avg_duration_ms") * F.col("execution_count")),
                F.sum(F.when(F.col("avg_duration_ms").isNotNull(), F.col("execution_count"))),
            ).alias("avg_duration_ms"),
            ratio(
                F.sum(F.col("success_rate") * F.col("execution_count")),
                F.sum(F.when(F.col("success_rate").isNotNull(), F.col("execution_count"))),
            ).alias("success_rate"),
        )
        .drop("_runs")
        .orderBy(F.desc("total_workflows"), "name")
    )


def task_clusters_grouped_page(paths: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of the groups, largest first; a far page sorts only the ranges that hold it."""
    order = [F.desc("total_workflows"), F.col("name")]
    return paging.page(task_clusters_grouped(paths), order, offset, limit)


def group_path_ids(paths: DataFrame, group: str) -> DataFrame:
    return paths.filter(text.in_group(F.col("task_cluster"), group)).select("path_id")


PathIds = list[str] | DataFrame  # ids given one by one, or a table with the column path_id


def select_paths(paths: DataFrame, path_ids: PathIds) -> DataFrame:
    """The given paths; an empty list selects nothing."""
    if isinstance(path_ids, DataFrame):
        return paths.join(path_ids.select("path_id"), "path_id", "left_semi").select(*paths.columns)
    return paths.filter(F.col("path_id").isin(path_ids)) if path_ids else paths.filter(F.lit(False))


def matched_workflows(
    embeddings: DataFrame, paths: DataFrame, path_ids: PathIds, threshold: float
) -> DataFrame:
    """Workflows similar to any of the paths with their highest similarity."""
    best = match_paths(embeddings, select_paths(paths, path_ids), threshold, keep="best_path")
    return best.select("workflow_id", "similarity")


def scoped_events(event_logs: DataFrame, matched: DataFrame) -> DataFrame:
    """Events of the matched workflows."""
    return event_logs.join(matched.select("workflow_id"), "workflow_id", "left_semi")


def cluster_workflows(
    event_logs: DataFrame, embeddings: DataFrame, paths: DataFrame,
    path_ids: PathIds, threshold: float,
) -> DataFrame:
    """Finished workflows matched by the paths, with mode and total cost."""
    matched = matched_workflows(embeddings, paths, path_ids, threshold)
    totals = workflow_rollup(scoped_events(event_logs, matched)).select(
        "workflow_id", "is_guided", "total_cost_usd"
    )
    return (
        matched.join(embeddings.select("workflow_id", "task_description"), "workflow_id")
        .join(
            terminal_events(event_logs).select(
                "workflow_id", "status", "duration_ms", F.col("step_number").alias("steps"), "timestamp"
            ),
            "workflow_id",
        )
        .join(totals, "workflow_id")
        .select(
            "workflow_id", "task_description", F.round("similarity", 4).alias("similarity"),
            "status", "duration_ms", "steps", "timestamp",
            mode_label(F.col("is_guided") == 1).alias("mode"),
            F.col("total_cost_usd").cast("double").alias("cost_usd"),
        )
        .orderBy(F.desc("timestamp"), "workflow_id")
    )


def cluster_mode_stats(
    event_logs: DataFrame, embeddings: DataFrame, paths: DataFrame,
    path_ids: PathIds, threshold: float,
) -> DataFrame:
    matched = matched_workflows(embeddings, paths, path_ids, threshold)
    return mode_statistics(workflow_rollup(scoped_events(event_logs, matched)))


def average_conformance(
    event_logs: DataFrame, embeddings: DataFrame, paths: DataFrame,
    path_ids: PathIds, threshold: float,
) -> DataFrame:
    """Mean position-wise conformance of the matched workflows to their best path.

    Each distinct sequence is scored once, over the longer length; an empty sequence and a
    group without paths score 0.
    """
    matched = matched_workflows(embeddings, paths, path_ids, threshold)
    sequences = ordered_sequences(tool_calls(scoped_events(event_logs, matched)))
    wanted = select_paths(paths, path_ids).select(F.xxhash64("path_id").alias("at"), "tool_sequence")
    weighted = sequences.groupBy("tool_sequence").agg(F.count("*").alias("n"))
    best = best_paths(weighted, wanted, over="longest").select("tool_sequence", "score")
    score = F.coalesce("score", F.lit(0.0))
    return weighted.join(best, "tool_sequence", "left").agg(
        ratio(F.sum(score * F.col("n")), F.sum("n")).alias("avg_conformance"))


def cluster_graph_nodes(event_logs, embeddings, paths, path_ids, threshold) -> DataFrame:
    matched = matched_workflows(embeddings, paths, path_ids, threshold)
    return graph_nodes(scoped_events(event_logs, matched))


def cluster_graph_edges(event_logs, embeddings, paths, path_ids, threshold) -> DataFrame:
    matched = matched_workflows(embeddings, paths, path_ids, threshold)
    return transitions(scoped_events(event_logs, matched))


def cluster_bottlenecks(event_logs, embeddings, paths, path_ids, threshold) -> DataFrame:
    matched = matched_workflows(embeddings, paths, path_ids, threshold)
    return tool_stats(tool_calls(scoped_events(event_logs, matched))).orderBy(
        F.desc_nulls_last("avg_duration_ms"), "tool_name"
    )


def group_distinct_paths(event_logs, embeddings, paths, path_ids, threshold) -> DataFrame:
    """Distinct tool sequences (in time order) of a group's workflows with counts."""
    matched = matched_workflows(embeddings, paths, path_ids, threshold)
    return (
        ordered_sequences(tool_calls(scoped_events(event_logs, matched)), by_time=True)
        .groupBy("tool_sequence")
        .agg(F.count("*").alias("workflow_count"))
        .orderBy(F.desc("workflow_count"), "tool_sequence")
    )


def group_overview(paths: DataFrame, group: str) -> DataFrame:
    """Run count, weighted means and the optimal sequence of a group.

    The group's own path gives the sequence; without one it is the variant with the
    highest (success rate, executions).
    """
    members = paths.filter(text.in_group(F.col("task_cluster"), group))
    runs = F.col("execution_count")

    def weighted(column):
        return ratio(
            F.sum(F.col(column) * runs), F.sum(F.when(F.col(column).isNotNull(), runs))
        ).alias(column)

    own = F.max(F.when(F.col("task_cluster") == group, F.col("tool_sequence")))
    variant = F.max_by(
        "tool_sequence",
        F.struct(F.coalesce("success_rate", F.lit(0.0)), runs, F.col("task_cluster")),
    )
    return members.groupBy().agg(
        F.sum(runs).alias("total_workflows"),
        F.count(F.when(F.col("task_cluster") != group, 1)).alias("variants"),
        weighted("avg_duration_ms"), weighted("avg_steps"), weighted("success_rate"),
        F.coalesce(own, variant, F.expr("cast(array() as array<string>)")).alias("optimal_sequence"),
    )


def best_variants(paths: DataFrame) -> DataFrame:
    """Per group the variant with the best success rate and the longest one."""
    parent = text.parent_group(F.col("task_cluster"))
    return paths.groupBy(parent.alias("name")).agg(
        F.max_by("task_cluster", F.struct("success_rate", "execution_count", "task_cluster")).alias("best_variant"),
        F.max_by("task_cluster", F.struct(F.size("tool_sequence"), F.col("task_cluster"))).alias("longest_variant"),
        F.max(F.size("tool_sequence")).alias("longest_steps"),
    )
