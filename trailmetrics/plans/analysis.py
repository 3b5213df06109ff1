"""The whole mining run: clusters, sub-clusters, graphs, paths, warnings, new paths.

All clusters are analysed at once: every operator is keyed by ``task_key``, which is
a cluster label (group level) or ``label/subcluster``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmetrics.operators.anomalies import detect_patterns
from trailmetrics.operators.clustering import (
    cluster_by_embedding, cluster_names, short_descriptions, subcluster_by_trace,
)
from trailmetrics.operators.decision_tree import decision_trees
from trailmetrics.operators.failure_warnings import failure_warnings
from trailmetrics.operators.graphs import align_runs, directly_follows_graph, model_quality, process_model
from trailmetrics.operators.path_search import find_pareto_paths, knee_points
from trailmetrics.operators.similarity import centroid
from trailmetrics.operators.suggestions import generate_suggestions
from trailmetrics.operators.traces import build_traces
from trailmetrics.session import materialize, together
from trailmetrics.sources import snapshots
from trailmetrics.sources.derived import cleared, replace_paths


@dataclass(frozen=True)
class Settings:
    """Defaults of an analysis run."""

    similarity_threshold: float = 0.78
    min_executions: int = 5
    min_success_rate: float = 0.85
    ned_threshold: float = 0.55
    bottleneck_share: float = 0.40
    redundancy_min_calls: int = 2


@dataclass
class AnalysisResult:
    """Result tables; all but ``members`` and ``optimal_paths`` are keyed by task_key."""

    members: DataFrame
    traces: DataFrame
    graph: DataFrame
    model: DataFrame
    quality: DataFrame
    patterns: DataFrame
    pareto_paths: DataFrame
    best_paths: DataFrame
    suggestions: DataFrame
    warnings: DataFrame
    optimal_paths: DataFrame


def mode_success_rates(traces: DataFrame, key: str) -> DataFrame:
    """Share of completed runs per mode among runs that ended.

    A run with events of both modes counts once, as guided.
    """
    ended = F.col("n_terminal") > 0
    done = F.when(F.col("completed"), 1.0).otherwise(0.0)
    return traces.groupBy(key).agg(
        F.avg(F.when(ended & F.col("is_guided"), done)).alias("guided_success_rate"),
        F.avg(F.when(ended & ~F.col("is_guided"), done)).alias("exploration_success_rate"),
    )


def cluster_members(
    event_logs: DataFrame, embeddings: DataFrame, settings: Settings
) -> tuple[DataFrame, DataFrame]:
    """Traces of clustered runs with cluster label, name and sub-cluster, and the texts of all runs.

    Descriptions may be whole documents, so they stay in their table, and members take theirs
    from it when they are read; see ``with_texts``.
    """
    texts = embeddings.filter(F.col("embedding").isNotNull()).select("workflow_id", "task_description")
    clustered, built = together(
        lambda: materialize(
            cluster_by_embedding(embeddings, settings.similarity_threshold, settings.min_executions)
            .select("workflow_id", "cluster_label"),
            "clustered",
        ),
        lambda: materialize(build_traces(event_logs), "run-traces"),
    )
    traces = materialize(built.join(clustered, "workflow_id"), "clustered-traces")
    shaped = materialize(subcluster_by_trace(traces, "cluster_label", settings.ned_threshold), "shaped")
    names = cluster_names(clustered, short=short_descriptions(texts))
    counts = shaped.groupBy("cluster_label").agg(F.countDistinct("subcluster").alias("n_subclusters"))
    members = materialize(
        traces.join(shaped, ["cluster_label", "workflow_id"])
        .join(names, "cluster_label").join(counts, "cluster_label"),
        "cluster-members",
    )
    return members, texts


def with_texts(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Members, or runs by task, with their descriptions."""
    return rows.join(texts, "workflow_id").select(*rows.columns, "task_description")


def both_levels(members: DataFrame) -> DataFrame:
    """Each run twice: under its sub-cluster and under its whole cluster.

    Keys without any successful run are left out of the analysis.
    """
    sub = members.withColumn("task_key", F.concat_ws("/", "cluster_label", "subcluster")).withColumn(
        "task_name",
        F.when(F.col("n_subclusters") > 1, F.concat("task_cluster", F.lit(" ("), "subcluster", F.lit(")")))
        .otherwise(F.col("task_cluster")),
    )
    whole = members.withColumn("task_key", F.col("cluster_label")).withColumn("task_name", F.col("task_cluster"))
    both = sub.unionByName(whole)
    viable = both.filter("success").select("task_key").distinct()
    return both.join(viable, "task_key", "left_semi")


def run_analysis(
    event_logs: DataFrame, embeddings: DataFrame, settings: Settings = Settings()
) -> AnalysisResult:
    """Mine every cluster and derive the new table of optimal paths.

    Graph and path search use successful runs only; patterns, model quality and
    warnings use all runs.  Path search, conformance and decision trees do not need each other
    and run at the same time.
    """
    members, texts = cluster_members(event_logs, embeddings, settings)
    traces = materialize(both_levels(members), "task-traces")
    good = traces.filter("success")
    key = "task_key"

    keyed = traces.select("workflow_id", key, "success", "total_duration_ms")

    def searched() -> tuple[DataFrame, DataFrame]:
        graph = materialize(directly_follows_graph(event_logs, good.select("workflow_id", key, "success"), key), "graph")
        return graph, materialize(find_pareto_paths(graph, good, key, settings.min_success_rate), "pareto")

    def judged() -> tuple[DataFrame, DataFrame, DataFrame]:
        model = materialize(process_model(event_logs, keyed, key), "model")
        aligned = align_runs(event_logs, keyed, model, key)
        patterns = detect_patterns(
            event_logs, keyed, model, key, settings.redundancy_min_calls, settings.bottleneck_share, aligned)
        return model, model_quality(event_logs, keyed, model, key, aligned), materialize(patterns, "patterns")

    (graph, pareto), (model, quality, patterns), trees = together(
        searched, judged, lambda: decision_trees(event_logs, members, "cluster_label"))
    best = knee_points(pareto)
    suggestions = generate_suggestions(event_logs, traces, best, patterns, key)
    warnings = failure_warnings(event_logs, keyed, best, key)
    return AnalysisResult(
        with_texts(members, texts), with_texts(traces, texts), graph, model, quality, patterns, pareto, best,
        suggestions, warnings,
        optimal_path_rows(event_logs, embeddings, members, best, trees),
    )


def store_result(result: AnalysisResult, path: str, batch: str, clear: bool = False) -> int:
    """Put the run's paths into the stored table of optimal paths and return its version.

    Paths of the same name are replaced, or all are (``clear``); a run that is stored again
    under its batch name changes nothing, and readers see the old table until all is written.
    """
    def change(current: DataFrame | None) -> DataFrame:
        if current is None:
            return result.optimal_paths
        return replace_paths(cleared(current) if clear else current, result.optimal_paths)

    return snapshots.update(result.optimal_paths.sparkSession, path, change, batch)


def primary_and_alternatives(members: DataFrame, best: DataFrame) -> DataFrame:
    """Per cluster the path of its largest sub-cluster; the other paths as a list."""
    sizes = members.groupBy("cluster_label", "task_cluster", "subcluster").agg(F.count("*").alias("runs"))
    found = sizes.withColumn("task_key", F.concat_ws("/", "cluster_label", "subcluster")).join(
        best.select("task_key", "tool_sequence", "avg_duration_ms", "avg_steps", "success_rate"), "task_key"
    )
    listed = found.groupBy("cluster_label", "task_cluster").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    (-F.col("runs")).alias("o"), "subcluster", "tool_sequence", "avg_duration_ms",
                    "avg_steps", "success_rate", "runs",
                )
            )
        ).alias("all")
    )
    first = F.get("all", F.lit(0))
    return listed.select(
        "cluster_label", "task_cluster", first["tool_sequence"].alias("tool_sequence"),
        first["avg_duration_ms"].alias("avg_duration_ms"), first["avg_steps"].alias("avg_steps"),
        first["success_rate"].alias("success_rate"),
        F.transform(
            F.filter("all", lambda _, i: i > 0),
            lambda p: F.struct(
                p["tool_sequence"].alias("tool_sequence"), p["runs"].alias("execution_count"),
                p["success_rate"].alias("success_rate"), p["avg_steps"].alias("avg_steps"),
            ),
        ).alias("alternative_paths"),
    )


def optimal_path_rows(
    event_logs: DataFrame, embeddings: DataFrame, members: DataFrame, best: DataFrame, trees: DataFrame
) -> DataFrame:
    """New rows of the table of optimal paths, one per cluster with a path; ``trees`` has the clusters' decision trees.

    ``execution_count`` is the size of the cluster.  Clusters with the same name
    replace each other; the one with the largest label wins.
    """
    primary = materialize(primary_and_alternatives(members, best), "primary")
    label = "cluster_label"
    vectors = embeddings.filter(F.col("embedding").isNotNull()).join(
        members.select("workflow_id", label), "workflow_id"
    )
    size = members.groupBy(label).agg(
        F.count("*").alias("execution_count"), F.max("last_timestamp").alias("updated_at")
    )
    keyed = members.select("workflow_id", label, "success")
    rows = (
        primary.join(size, label)
        .join(mode_success_rates(members, label), label)
        .join(centroid(vectors, label).withColumnRenamed("centroid", "embedding"), label, "left")
        .join(failure_warnings(event_logs, keyed, primary, label), label, "left")
        .join(trees, label, "left")
        .withColumn("failure_warnings", F.coalesce("failure_warnings", F.expr("cast(array() as array<string>)")))
    )
    winners = rows.groupBy("task_cluster").agg(F.max(label).alias(label))
    return rows.join(winners, ["task_cluster", label], "left_semi").select(
        F.sha2(F.concat_ws("|", "task_cluster", "tool_sequence"), 256).alias("path_id"),
        "task_cluster", "tool_sequence", "avg_duration_ms", "avg_steps", "success_rate",
        "execution_count", "embedding", "guided_success_rate", "exploration_success_rate",
        "failure_warnings", "alternative_paths", "decision_tree", "updated_at",
    )
