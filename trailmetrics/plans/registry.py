"""Every registered query as a function of (spark, sf_dir).

``tidy`` gives results a plain shape: doubles and decimals rounded to 4 places
(after adding 1e-9, so that exact ties round up on every engine), whole numbers as bigint, times as text, arrays joined with ``>``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmetrics.functions import measures, sequences, text
from trailmetrics.functions.measures import money
from trailmetrics.operators import (
    anomalies, clustering, decision_tree, edit_distance, failure_warnings, graphs, path_search, reports, rules,
    significance, similarity, suggestions,
)
from trailmetrics.operators.events import cost_map, terminal_events, tool_calls, tool_stats
from trailmetrics.operators.traces import (
    build_traces, common_prefix_length, most_frequent_sequence, variants,
)
from trailmetrics.plans import analysis, clusters, dashboards, guidance
from trailmetrics.session import fresh_path, location, materialize
from trailmetrics.sources import derived, ingest, snapshots
from trailmetrics.sources.driver_tables import Tables, load_tables
from trailmetrics.sources.schemas import EVENT_COLUMNS
from trailmetrics.sources.shop_tables import Shop
from trailmetrics.streaming import jobs

Query = Callable[[Tables], DataFrame]

THRESHOLD = 0.15  # the driver's random vectors have no pairs above 0.6
GROUP = "Group 0"


def tidy(df: DataFrame) -> DataFrame:
    out = []
    for field in df.schema.fields:
        c, t = F.col(f"`{field.name}`"), field.dataType
        if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double") + 1e-9, 4)
        elif isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(t, T.DateType):
            c = c.cast("string")
        elif isinstance(t, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ">")
        out.append(c.alias(field.name))
    return df.select(*out)


def group_ids(t: Tables) -> DataFrame:
    """Path ids of the example group; one row per stored variant of the group."""
    return clusters.group_path_ids(t.optimal_paths, GROUP)


def first_workflow(t: Tables) -> str:
    return t.event_logs.agg(F.min("workflow_id").alias("w")).first()["w"]


def scoped(function) -> tuple[Query, Query]:
    """A cluster query for one path and for the whole example group."""
    def one(t: Tables) -> DataFrame:
        return function(t.event_logs, t.workflow_embeddings, t.optimal_paths, ["path-3"], THRESHOLD)

    def group(t: Tables) -> DataFrame:
        return function(t.event_logs, t.workflow_embeddings, t.optimal_paths, group_ids(t), THRESHOLD)

    return one, group


def _guided(t: Tables) -> DataFrame:
    return guidance.guidance(
        t.workflow_embeddings, t.optimal_paths, THRESHOLD, 30, margin=0.04, min_success_rate=0.6
    )


def dashboard_queries() -> dict[str, Query]:
    log: dict[str, Callable[[DataFrame], DataFrame]] = {
        "analytics_summary": dashboards.analytics_summary,
        "analytics_top_tools": dashboards.top_tools,
        "mode_distribution": dashboards.mode_distribution,
        "mode_comparison": dashboards.mode_comparison,
        "timeline": dashboards.timeline,
        "execution_graph_nodes": dashboards.execution_graph_nodes,
        "execution_graph_edges": dashboards.execution_graph_edges,
        "bottlenecks": dashboards.bottlenecks,
        "savings": dashboards.savings,
        "mode_breakdown": dashboards.mode_breakdown,
        "performance_over_time": dashboards.performance_over_time,
        "performance_axes": dashboards.performance_axes,
        "cost_leaks": dashboards.cost_leaks,
        "bottleneck_quadrant": dashboards.bottleneck_quadrant,
        "trace_timeline": dashboards.trace_timeline,
        "insights_summary": dashboards.insights_summary,
        "guided_share": dashboards.guided_share,
        "comparison_cards": dashboards.comparison_cards,
    }
    out: dict[str, Query] = {
        name: (lambda t, f=function: f(t.event_logs)) for name, function in log.items()
    }
    out["workflow_trace"] = lambda t: dashboards.workflow_trace(
        t.event_logs, t.workflow_embeddings, first_workflow(t)
    ).select("event_id", "workflow_id", "timestamp", "activity", "tool_name", "status",
             "duration_ms", "step_number", "task_description")
    out["list_workflows"] = lambda t: dashboards.list_workflows(t.event_logs, t.workflow_embeddings, 50, 10)
    out["list_workflows_far"] = lambda t: dashboards.list_workflows_far(t.event_logs, t.workflow_embeddings, 40, 300)
    out["list_workflows_total"] = lambda t: dashboards.terminal_events(t.event_logs).agg(
        F.count("*").alias("total"))
    out["list_optimal_paths"] = lambda t: dashboards.list_optimal_paths(t.optimal_paths)
    out["list_active_workflows"] = lambda t: dashboards.list_active_workflows(t.event_logs, t.workflow_embeddings)
    out["guided_readiness"] = lambda t: dashboards.guided_readiness(t.optimal_paths, 200)
    out["runs_by_type"] = lambda t: dashboards.runs_by_type(t.event_logs, t.workflow_embeddings)
    return out


def cluster_queries() -> dict[str, Query]:
    out: dict[str, Query] = {
        "task_clusters": lambda t: clusters.task_clusters(t.optimal_paths, t.workflow_embeddings, THRESHOLD),
        "task_clusters_grouped": lambda t: clusters.task_clusters_grouped(t.optimal_paths),
        "task_clusters_grouped_page": lambda t: clusters.task_clusters_grouped_page(t.optimal_paths, 3, 2),
        "group_overview": lambda t: clusters.group_overview(t.optimal_paths, GROUP),
        "group_best_variants": lambda t: clusters.best_variants(t.optimal_paths),
        "fetch_group_path_ids": lambda t: clusters.group_path_ids(t.optimal_paths, GROUP),
        "group_distinct_paths": scoped(clusters.group_distinct_paths)[1],
        "similar_paths": lambda t: guidance.similar_paths(t.workflow_embeddings, t.optimal_paths, 30, 0.6),
        "guidance": lambda t: _guided(t).drop("failure_warnings", "alternative_paths", "decision_tree"),
        "guidance_text": lambda t: guidance.guidance_text(_guided(t)).select("workflow_id", "guidance_text"),
        "best_path_match": lambda t: guidance.best_path_match(build_traces(t.event_logs), t.optimal_paths)
        .select("tool_sequence", "score", "path_id", "alignment"),
        "optimization_context": lambda t: guidance.optimization_context(
            build_traces(t.event_logs), t.optimal_paths, dashboards.mode_comparison(t.event_logs)),
    }
    for suffix, function in {
        "detail": clusters.cluster_workflows,
        "mode_stats": clusters.cluster_mode_stats,
        "conformance": clusters.average_conformance,
        "execution_graph_nodes": clusters.cluster_graph_nodes,
        "execution_graph_edges": clusters.cluster_graph_edges,
        "bottlenecks": clusters.cluster_bottlenecks,
    }.items():
        out[f"cluster_{suffix}"], out[f"group_{suffix}"] = scoped(function)
    return out


def evidence_text(df: DataFrame) -> DataFrame:
    """Evidence map as sorted ``name=value`` text."""
    pairs = F.transform(
        F.map_entries("evidence"), lambda e: F.concat(e["key"], F.lit("="), e["value"])
    )
    return df.withColumn("evidence", F.array_join(F.array_sort(pairs), ","))


def optimal_by_cluster(t: Tables) -> DataFrame:
    """Most frequent sequence and mean duration of every planted cluster."""
    means = t.traces.groupBy("task_cluster").agg(F.avg("total_duration_ms").alias("avg_duration_ms"))
    return most_frequent_sequence(t.traces, "task_cluster").join(means, "task_cluster")


def by_first_band(t: Tables) -> DataFrame:
    """Runs clustered by first tool, sub-clustered by the value band of their first call."""
    first = t.event_logs.filter((F.col("step_number") == 1) & F.col("tool_name").isNotNull()).select(
        "workflow_id", F.get_json_object("tool_response", "$.band").alias("band"))
    return t.traces.join(first, "workflow_id").select(
        "workflow_id", "tool_sequence", "success",
        F.concat(F.lit("starts "), F.get("tool_sequence", F.lit(0))).alias("task_cluster"),
        F.concat(F.lit("band "), "band").alias("subcluster"))


def by_second_tool(t: Tables) -> DataFrame:
    """Runs clustered by first tool, sub-clustered by second tool."""
    return t.traces.filter(F.size("tool_sequence") > 0).select(
        "workflow_id", "tool_sequence", "success",
        F.concat(F.lit("starts "), F.get("tool_sequence", F.lit(0))).alias("task_cluster"),
        F.coalesce(F.concat(F.lit("then "), F.get("tool_sequence", F.lit(1))), F.lit("ends"))
        .alias("subcluster"))


def tree_rows(trees: DataFrame) -> DataFrame:
    """One row per branch of each tree, with its place in the tree."""
    return trees.select("task_cluster", "decision_tree.*").select(
        "*", F.posexplode("branches").alias("pos", "branch")).drop("branches").select("*", "branch.*").drop("branch")


def mining_queries() -> dict[str, Query]:
    def dfg(t: Tables) -> DataFrame:
        return graphs.directly_follows_graph(t.event_logs, t.traces.select("workflow_id", "task_cluster", "success"))

    def model(t: Tables) -> DataFrame:
        return graphs.process_model(t.event_logs, t.traces, min_frequency=10)

    def run_alignments(t: Tables) -> DataFrame:
        """Every distinct run against the moves that are a sixth of their source's or more."""
        full = graphs.process_model(t.event_logs, t.traces)
        left = full.groupBy("task_cluster", "source").agg(F.sum("frequency").alias("visits"))
        common = full.join(left, ["task_cluster", "source"]).filter("6 * frequency >= visits")
        runs = graphs.runs_by_time(t.event_logs, t.traces).groupBy("task_cluster", "tool_sequence").agg(F.count("*").alias("n"))
        return graphs.alignments(runs, materialize(common, "model"))

    def patterns(t: Tables, with_model: bool) -> DataFrame:
        return anomalies.detect_patterns(
            t.event_logs, t.traces, model(t) if with_model else None, bottleneck_share=0.24)

    def found(t: Tables) -> DataFrame:
        longest = t.traces.agg(F.max("total_steps").alias("m")).first()["m"]
        return path_search.enumerate_paths(path_search.keep_reliable_edges(dfg(t), 0.5), longest + 1)

    def covering(t: Tables) -> DataFrame:
        return path_search.covering_paths(found(t), path_search.group_sizes(t.traces))

    def metrics(t: Tables) -> DataFrame:
        candidates = materialize(path_search.with_fallback(covering(t), t.traces), "candidate-paths")
        return path_search.path_metrics(variants(t.traces, "task_cluster"), candidates)

    def supported(t: Tables) -> DataFrame:
        return path_search.supported_paths(metrics(t), path_search.group_sizes(t.traces), 0.5, share=0.005)

    def pareto(t: Tables) -> DataFrame:
        return path_search.find_pareto_paths(dfg(t), t.traces, min_success_rate=0.5, support_share=0.005)

    def pareto_of_many_tools(t: Tables) -> DataFrame:
        """Every call's tool named by its parameter: 31 tools, and hardly two runs alike."""
        k = F.get_json_object("tool_parameters", "$.k").cast("int")
        logs = t.event_logs.withColumn(
            "tool_name", F.when(F.col("tool_name").isNotNull(), F.concat(F.lit("tool "), k % 31)))
        runs = materialize(build_traces(logs).join(t.traces.select("workflow_id", "task_cluster"), "workflow_id"), "traces")
        edges = graphs.directly_follows_graph(logs, runs.select("workflow_id", "task_cluster", "success"))
        return path_search.find_pareto_paths(edges, runs, min_success_rate=0.5, support_share=0.005)

    def fields(t: Tables) -> DataFrame:
        members = by_first_band(t)
        split = decision_tree.branching(decision_tree.representatives(members))
        responses = decision_tree.branch_responses(t.event_logs, members, split)
        return decision_tree.discriminating_fields(decision_tree.value_profiles(responses))

    return {
        "traces": lambda t: build_traces(t.event_logs).select(
            "workflow_id", "tool_sequence", "total_duration_ms", "total_cost_usd", "total_steps", "success"),
        "directly_follows_graph": dfg,
        "graph_totals": lambda t: t.traces.groupBy("task_cluster").agg(F.count("*").alias("total_traces")).join(
            dfg(t).select("task_cluster", F.explode(F.array("source", "target")).alias("node"))
            .groupBy("task_cluster").agg(F.countDistinct("node").alias("nodes")), "task_cluster"),
        "process_model": model,
        "model_quality": lambda t: graphs.model_quality(t.event_logs, t.traces, model(t)),
        "run_alignments": run_alignments,
        "conformance_deviations": lambda t: evidence_text(
            anomalies.conformance_deviations(t.event_logs, t.traces, model(t))),
        "redundant_steps": lambda t: evidence_text(anomalies.redundant_steps(t.event_logs, t.traces)),
        "retry_loops": lambda t: evidence_text(anomalies.retry_loops(t.event_logs, t.traces)),
        "bottleneck_tools": lambda t: evidence_text(
            anomalies.bottleneck_tools(t.event_logs, t.traces, threshold=0.24)),
        "detect_patterns": lambda t: evidence_text(patterns(t, True)),
        "loop_steps": lambda t: anomalies.loop_steps(t.event_logs),
        "reliable_edges": lambda t: path_search.keep_reliable_edges(dfg(t), 0.7).select(
            "task_cluster", "source", "target", "frequency"),
        "enumerate_paths": found,
        "covering_paths": covering,
        "most_frequent_sequences": lambda t: most_frequent_sequence(t.traces, "task_cluster"),
        "path_metrics": metrics,
        "supported_paths": supported,
        "pareto_front": lambda t: path_search.pareto_front(supported(t)),
        "find_pareto_paths": pareto,
        "find_pareto_paths_many_tools": pareto_of_many_tools,
        "knee_points": lambda t: path_search.knee_points(pareto(t)),
        "missing_step_warnings": lambda t: failure_warnings.missing_step_warnings(
            t.event_logs, t.traces, optimal_by_cluster(t), in_success=0.2, missing_in_failed=0.2),
        "parameter_warnings": lambda t: failure_warnings.parameter_warnings(
            t.event_logs, t.traces, optimal_by_cluster(t), success_share=0.0, failed_share=0.0),
        "failure_warnings": lambda t: failure_warnings.failure_warnings(
            t.event_logs, t.traces, optimal_by_cluster(t), success_share=0.0, failed_share=0.0),
        "discriminating_fields": fields,
        "decision_tree_by_band": lambda t: decision_tree.branch_rows(t.event_logs, by_first_band(t)),
        "decision_tree_by_second_tool": lambda t: decision_tree.branch_rows(t.event_logs, by_second_tool(t)),
        "decision_trees_by_band": lambda t: tree_rows(decision_tree.decision_trees(t.event_logs, by_first_band(t))),
        "decision_trees_by_second_tool": lambda t: tree_rows(
            decision_tree.decision_trees(t.event_logs, by_second_tool(t))),
        "pattern_suggestions": lambda t: suggestions.from_patterns(patterns(t, True)),
        "reorder_suggestions": lambda t: suggestions.reorderings(t.traces, optimal_by_cluster(t)),
        "skip_suggestions": lambda t: suggestions.skippable_steps(
            t.event_logs, t.traces, optimal_by_cluster(t),
            anomalies.retry_loops(t.event_logs, t.traces)),
        "generate_suggestions": lambda t: suggestions.generate_suggestions(
            t.event_logs, t.traces, optimal_by_cluster(t), patterns(t, False)),
        "mode_significance": lambda t: significance.mode_significance(t.event_logs),
    }


def operator_queries() -> dict[str, Query]:
    def per_event(t: Tables) -> DataFrame:
        """Source events with their number ``k``, one row per tool call."""
        return t.raw("events").select(
            F.col("event_id").cast("string").alias("event_id"),
            F.get_json_object("props", "$.k").cast("int").alias("k"), "event_type", "value", "ts", "user_id")

    def raw_events(t: Tables) -> DataFrame:
        """Events as a client might send them: text fields, some missing, some wrong."""
        shape = F.col("event_id").cast("bigint") % 5
        e = per_event(t)
        given = {
            "event_id": F.col("event_id"), "workflow_id": F.concat(F.lit("wf-"), "user_id"),
            "timestamp": F.col("ts").cast("string"),
            "activity": F.when(shape == 2, "  ").otherwise(F.concat(F.lit("tool_call:"), "event_type")),
            "agent_name": F.lit("a"), "agent_role": F.lit("r"), "tool_name": F.col("event_type"),
            "duration_ms": F.when(shape != 3, F.col("value").cast("string")),
            "status": F.when(shape == 1, "nonsense").when(shape != 4, "success"),
        }
        return e.select(*[given.get(c, F.lit(None).cast("string")).alias(c) for c in EVENT_COLUMNS])

    def half_null(t: Tables) -> DataFrame:
        """Text vectors, some missing."""
        text_vector = F.concat(F.lit("["), F.array_join(F.col("embedding").cast("array<string>"), ","), F.lit("]"))
        return t.raw("embeddings").select("vec_id", F.when(F.col("label") != 3, text_vector).alias("embedding"))

    def upserted(t: Tables) -> DataFrame:
        even = F.substring_index("workflow_id", "-", 1).cast("bigint") % 2 == 0
        again = t.workflow_embeddings.filter(even).select(
            "workflow_id", F.lit("changed").alias("task_description"), "embedding",
            F.lit("second").alias("model_version"), "created_at")
        new = again.withColumn("workflow_id", F.concat(F.lit("new-"), "workflow_id")).withColumn(
            "task_description", F.lit("fresh"))
        return derived.upsert_embeddings(t.workflow_embeddings, again.unionByName(new)).select(
            "workflow_id", "task_description", "model_version")

    def replaced(t: Tables) -> DataFrame:
        new = t.optimal_paths.filter(F.col("execution_count") >= 200).withColumn(
            "execution_count", F.lit(0).cast("bigint"))
        return derived.replace_paths(t.optimal_paths, new).select("task_cluster", "execution_count")

    def emptied(t: Tables) -> DataFrame:
        return t.optimal_paths.filter(F.col("execution_count") >= 200).withColumn(
            "execution_count", F.lit(0).cast("bigint"))

    def stored(t: Tables, *changes: tuple[str, Callable[[DataFrame], DataFrame]]) -> str:
        """The paths as version 1 of a table, then a version per (batch, change)."""
        path = fresh_path(t.spark, "stored-paths")
        snapshots.update(t.spark, path, lambda _: t.optimal_paths, "load")
        for batch, change in changes:
            snapshots.update(t.spark, path, change, batch)
        return path

    def stored_replaced(t: Tables) -> DataFrame:
        """A round's rows, the same batch again, and the batch again with other rows."""
        new = emptied(t)
        other = new.withColumn("execution_count", F.lit(-1).cast("bigint"))
        path = stored(t, *[("round", lambda now, rows=rows: derived.replace_paths(now, rows)) for rows in (new, new, other)])
        last = snapshots.versions(t.spark, path).agg(F.max("version").alias("version"))
        return snapshots.read(t.spark, path).select("task_cluster", "execution_count").join(last)

    def stored_versions(t: Tables) -> DataFrame:
        """Every version of a table that is loaded, cleared and filled again."""
        path = stored(t, ("clear", derived.cleared), ("fill", lambda now: derived.replace_paths(now, emptied(t))))
        every = [snapshots.read(t.spark, path, v).select(F.lit(v).alias("version"), "task_cluster", "execution_count")
                 for v in (1, 2, 3)]
        return every[0].union(every[1]).union(every[2])

    def stored_after_failure(t: Tables) -> DataFrame:
        """An update that breaks while it writes leaves the table as it was."""
        path = stored(t)
        broken = F.raise_error(F.concat(F.lit("broken row "), "task_cluster")).cast("bigint")
        try:
            snapshots.update(t.spark, path, lambda now: now.withColumn("execution_count", broken), "round")
        except Exception as error:
            if "broken row" not in str(error):
                raise
        last = snapshots.versions(t.spark, path).agg(F.max("version").alias("version"))
        return snapshots.read(t.spark, path).select("task_cluster", "execution_count").join(last)

    def appended(t: Tables) -> DataFrame:
        """The first event alone, then all others, then an empty batch."""
        path, first = fresh_path(t.spark, "appended"), F.col("event_id") == first_event(t)
        for part in (t.event_logs.filter(first), t.event_logs.filter(~first), t.event_logs.filter(F.lit(False))):
            ingest.append_events(part, path)
        return ingest.read_events(t.spark, path).select(
            "event_id", "workflow_id", "timestamp", "activity", "status", "step_number")

    def first_event(t: Tables) -> str:
        return t.event_logs.agg(F.min("event_id")).first()[0]

    def reanalysed(t: Tables) -> DataFrame:
        """JSON lines are taken in as a stream, then the whole log is analysed."""
        path = fresh_path(t.spark, "waiting")
        raw_events(t).select(F.to_json(F.struct("*")).alias("value")).write.text(f"{path}/lines")
        lines = t.spark.readStream.schema("value string").text(f"{path}/lines")
        return jobs.ingest_then(
            lines, f"{path}/events", f"{path}/refused", f"{path}/checkpoint",
            lambda log: log.groupBy("activity", "status").agg(
                F.count("*").alias("n"), F.sum("duration_ms").alias("total_ms")), strict_ids=False)

    def outcomes(t: Tables) -> DataFrame:
        k = F.col("k")
        answer = F.when(k < 10, F.concat(F.lit('{"error":"bad '), k, F.lit('"}'))).when(
            k < 50, F.concat(F.lit("plain "), k)).otherwise(F.concat(F.lit('{"k":'), k, F.lit("}")))
        return ingest.with_step_outcome(per_event(t).select("event_id", answer.alias("tool_response")))

    def cascade(t: Tables) -> DataFrame:
        k = F.col("k")
        step = F.when(k % 3 == 0, F.concat(F.lit("step-"), k)).when(k % 3 == 1, "")
        trace = F.when(k % 2 == 0, F.concat(F.lit("trace-"), k)).otherwise("")
        return per_event(t).select("event_id", ingest.effective_agent(step, trace, "default-agent").alias("agent"))

    def merged_list(t: Tables) -> DataFrame:
        active = dashboards.list_active_workflows(t.event_logs, t.workflow_embeddings)
        finished = dashboards.terminal_events(t.event_logs).withColumnRenamed("step_number", "steps")
        return reports.merged_workflow_list(active, finished)

    def live_and_stored(t: Tables) -> DataFrame:
        late = t.event_logs.filter(F.col("timestamp") >= F.lit("2024-01-20").cast("timestamp_ntz"))
        early = t.event_logs.filter(F.col("timestamp") < F.lit("2024-01-25").cast("timestamp_ntz"))
        return reports.merged_events(early, late.unionByName(late)).select("event_id", "workflow_id", "activity", "step_number")

    def edit_to_path(t: Tables) -> DataFrame:
        return edit_distance.distances_to_paths(
            t.traces.select("workflow_id", "task_cluster", "tool_sequence"), optimal_by_cluster(t)
        ).select("workflow_id", "edits", "ned")

    def other_runs(t: Tables) -> DataFrame:
        return t.workflow_embeddings.select(F.col("workflow_id").alias("path_id"), "embedding")

    def labels(t: Tables) -> DataFrame:
        name = F.concat(F.col("tool_name"), F.lit("_of_"), F.col("agent_name"))
        return t.event_logs.filter(F.col("tool_name").isNotNull()).select(
            "event_id", text.humanise(name).alias("humanised"), text.title_case(name).alias("titled"),
            text.truncate(F.col("activity"), 12, "…").alias("short"))

    def formatted(t: Tables) -> DataFrame:
        cost = F.col("total_cost_usd").cast("double") + 1e-9
        ms = F.col("duration_ms")
        return terminal_events(t.event_logs).join(cost_map(t.event_logs), "workflow_id").select(
            "workflow_id",
            F.when(ms < 1000, text.format_duration(ms)).otherwise(text.format_duration(ms + 1e-6)).alias("duration"),
            text.format_cost(cost).alias("cost"), text.format_timestamp(F.col("timestamp")).alias("at"),
            text.format_count(F.floor(ms).cast("double")).alias("whole_ms"),
            text.format_percent(ms / 10000 + 1e-9).alias("share"), measures.latency_band(ms).alias("band"), measures.delta_label(ms, F.lit(1000.0)).alias("delta"),
            measures.verdict(ms - 1000, True).alias("verdict"))

    def primaries(t: Tables) -> DataFrame:
        members = by_second_tool(t).withColumnRenamed("task_cluster", "cluster_label").withColumn(
            "task_cluster", F.col("cluster_label"))
        best = most_frequent_sequence(members, "cluster_label", "subcluster").select(
            F.concat_ws("/", "cluster_label", "subcluster").alias("task_key"), "tool_sequence",
            F.lit(0.0).alias("avg_duration_ms"), F.lit(0.0).alias("avg_steps"), F.lit(1.0).alias("success_rate"))
        sizes = members.groupBy("cluster_label").agg(F.count("*").alias("runs"))
        rest = F.aggregate("alternative_paths", F.lit(0).cast("bigint"), lambda s, p: s + p["execution_count"])
        return analysis.primary_and_alternatives(members, best).join(sizes, "cluster_label").select(
            "task_cluster", "tool_sequence", (F.col("runs") - rest).alias("primary_runs"),
            F.size("alternative_paths").alias("alternatives"), rest.alias("alternative_runs"))

    def embedding_clusters(t: Tables, **blocks: int) -> DataFrame:
        return clustering.cluster_by_embedding(t.workflow_embeddings, 0.78, 5, **blocks).groupBy("cluster_label").agg(
            F.min("workflow_id").alias("first_workflow"), F.count("*").alias("workflows"),
            F.min("task_description").alias("first_description")).drop("cluster_label")

    def prefixes(t: Tables) -> DataFrame:
        return common_prefix_length(by_second_tool(t), "task_cluster")

    def first_responses(t: Tables) -> DataFrame:
        place = F.struct("step_number", "timestamp", "event_id")
        return tool_calls(t.event_logs).groupBy("workflow_id", "tool_name").agg(
            F.min_by("tool_response", place).alias("tool_response"))

    def parameter_values(t: Tables) -> DataFrame:
        return tool_calls(t.event_logs).select(
            "tool_name", F.explode(F.from_json("tool_parameters", "map<string,string>")).alias("param", "value")
        ).groupBy("tool_name", "param", "value").agg(F.count("*").alias("n"))

    return {
        "normalised_events": lambda t: ingest.validate(raw_events(t), strict_ids=False)[0].select(
            "event_id", "activity", "tool_name", "status", "duration_ms", "step_number", "tool_response", "llm_model"),
        "rejected_events": lambda t: ingest.validate(raw_events(t), strict_ids=False)[1].select("event_id", "reason"),
        "workflow_ids": lambda t: ingest.workflow_ids(t.event_logs),
        "workflow_events": lambda t: ingest.workflow_events(t.event_logs, first_workflow(t)).select(
            "event_id", "activity", "step_number"),
        "task_lookup": lambda t: ingest.task_of(t.workflow_embeddings, first_workflow(t)).select(
            "workflow_id", "task_description", F.size("embedding").alias("dimensions")),
        "embedding_scan": lambda t: derived.read_embeddings(half_null(t)).select(
            "vec_id", F.size("embedding").alias("dimensions"),
            F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).alias("total")),
        "upserted_embeddings": upserted,
        "stored_paths_replaced": stored_replaced,
        "stored_paths_versions": stored_versions,
        "stored_paths_after_failure": stored_after_failure,
        "appended_events": appended,
        "reanalysed_after_stream": reanalysed,
        "replaced_paths": replaced,
        "purged_events": lambda t: derived.without_guided(t.event_logs, t.workflow_embeddings)[0]
        .select("event_id", "workflow_id", "activity"),
        "purged_embeddings": lambda t: derived.without_guided(t.event_logs, t.workflow_embeddings)[1]
        .select("workflow_id"),
        "event_log_frame": lambda t: ingest.event_log_frame(t.event_logs),
        "step_outcomes": outcomes,
        "agent_cascade": cascade,
        "tool_call_filter": lambda t: tool_calls(t.event_logs).agg(
            F.count("*").alias("n"), F.sum("duration_ms").alias("total_ms")),
        "trace_headers": lambda t: reports.trace_headers(t.event_logs),
        "mode_by_role": lambda t: reports.mode_by_role(t.event_logs),
        "merged_workflow_list": merged_list,
        "merged_events": live_and_stored,
        "parent_links": lambda t: ingest.steps_with_parent(t.event_logs).select(
            "event_id", "parent_event_id", "parent_activity"),
        "round_summary": lambda t: reports.round_summary(t.event_logs, F.to_date("timestamp").cast("string")),
        "drawn_edges": lambda t: reports.drawn_edges(t.event_logs, t.optimal_paths),
        "optimal_edges": lambda t: graphs.optimal_edges(t.optimal_paths),
        "tool_differences": lambda t: reports.tool_differences(t.traces, optimal_by_cluster(t)),
        "mode_success_rates": lambda t: analysis.mode_success_rates(t.traces, "task_cluster"),
        "centroids": lambda t: similarity.centroid(t.raw("embeddings"), "label").select(
            "label", F.posexplode("centroid").alias("pos", "x")),
        "cosine_to_centroid": lambda t: reports.pair_similarity(
            t.raw("embeddings").join(similarity.centroid(t.raw("embeddings"), "label"), "label").select(
                "vec_id", F.col("embedding").alias("a"), F.col("centroid").alias("b"))
        ).select("vec_id", "similarity"),
        "similar_workflow_pairs": lambda t: similarity.match_paths(t.workflow_embeddings, t.optimal_paths, THRESHOLD),
        "similar_run_pairs": lambda t: similarity.similar_pairs(t.workflow_embeddings, 0.95, block_rows=256),
        "similar_run_blocks": lambda t: similarity.block_report(t.workflow_embeddings, other_runs(t), 0.95, block_rows=256),
        "edit_distance_to_path": edit_to_path,
        "near_sequences": lambda t: edit_distance.near_sequences(t.traces, 1),
        "common_prefixes": prefixes,
        "collapsed_sequences": lambda t: t.traces.select(
            "workflow_id", sequences.collapse_repeats(F.col("tool_sequence")).alias("collapsed")),
        "first_responses": first_responses,
        "parameter_values": parameter_values,
        "retries": lambda t: anomalies.retries(t.event_logs).select("workflow_id", "step_number", "tool_name"),
        "guidance_blocks": lambda t: t.event_logs.filter(F.col("activity") == "optimize:guided").select(
            "workflow_id", text.guidance_block(F.col("llm_prompt")).alias("block")),
        "cluster_labels": lambda t: t.optimal_paths.select(
            "task_cluster", text.parent_group(F.col("task_cluster")).alias("parent"),
            text.variant_display_name(F.col("task_cluster"), F.lit("")).alias("variant"),
            text.truncate(F.col("task_cluster"), 5).alias("head")),
        "tool_labels": labels,
        "formatted_runs": formatted,
        "node_sizes": lambda t: tool_stats(tool_calls(t.event_logs)).select(
            "tool_name", measures.dot_radius(F.col("total_cost_usd").cast("double") * 10000).alias("radius")),
        "primary_paths": primaries,
        "cluster_by_embedding": embedding_clusters,
        "cluster_by_embedding_in_blocks": lambda t: embedding_clusters(t, block_rows=128),
        "cluster_names": lambda t: clustering.cluster_names(
            t.workflow_embeddings.join(t.labels, "workflow_id").withColumn(
                "cluster_label", F.concat(F.lit("cluster_"), "label"))),
        "subcluster_by_trace": lambda t: clustering.subcluster_by_trace(t.traces, "task_cluster"),
    }


def analysis_of(t: Tables) -> analysis.AnalysisResult:
    """The analysis run with default settings, once per set of tables."""
    if "analysis" not in t.results:
        t.results["analysis"] = analysis.run_analysis(t.event_logs, t.workflow_embeddings)
    return t.results["analysis"]


def analysis_queries() -> dict[str, Query]:
    """Results of the whole run; ``group`` ones are those of whole clusters."""
    def group(df: DataFrame) -> DataFrame:
        return df.filter(~F.col("task_key").contains("/")).withColumnRenamed("task_key", "task_cluster")

    def stored(t: Tables) -> DataFrame:
        """The run's paths in the stored table; storing the same run again changes nothing."""
        path = fresh_path(t.spark, "stored-paths")
        snapshots.update(t.spark, path, lambda _: t.optimal_paths, "load")
        for _ in range(2):
            analysis.store_result(analysis_of(t), path, "run-1")
        last = snapshots.versions(t.spark, path).agg(F.max("version").alias("version"))
        return snapshots.read(t.spark, path).select("task_cluster", "tool_sequence", "execution_count").join(last)

    return {
        "run_analysis_stored": stored,
        "run_analysis": lambda t: analysis_of(t).optimal_paths.select(
            "task_cluster", "tool_sequence", "avg_duration_ms", "avg_steps", "success_rate", "execution_count",
            "guided_success_rate", "exploration_success_rate", "failure_warnings",
            F.size("alternative_paths").alias("alternatives"),
            F.col("decision_tree.branch_tool").alias("branch_tool")),
        "run_analysis_alternatives": lambda t: analysis_of(t).optimal_paths.select(
            "task_cluster", F.posexplode("alternative_paths").alias("pos", "path")).select("task_cluster", "pos", "path.*"),
        "run_analysis_centroids": lambda t: analysis_of(t).optimal_paths.select(
            "task_cluster", F.posexplode("embedding").alias("pos", "x")),
        "run_analysis_suggestions": lambda t: analysis_of(t).suggestions,
        "run_analysis_warnings": lambda t: analysis_of(t).warnings,
        "run_analysis_graph": lambda t: analysis_of(t).graph,
        "run_analysis_quality": lambda t: analysis_of(t).quality,
        "run_analysis_patterns": lambda t: evidence_text(analysis_of(t).patterns),
        "run_analysis_pareto": lambda t: analysis_of(t).pareto_paths,
        "run_analysis_group_graph": lambda t: group(analysis_of(t).graph),
        "run_analysis_group_quality": lambda t: group(analysis_of(t).quality),
        "run_analysis_group_patterns": lambda t: evidence_text(group(analysis_of(t).patterns)),
        "run_analysis_group_pareto": lambda t: group(analysis_of(t).pareto_paths),
    }


def streaming_queries() -> dict[str, Query]:
    """Streams over the stored log, run to its end; results are read from the sink."""
    wide = "60 days"  # stored files are not in time order

    def stream(t: Tables) -> DataFrame:
        return jobs.event_stream(t.spark, location(t.event_logs), files_per_batch=3)

    def finished(t: Tables, df: DataFrame) -> DataFrame:
        path = fresh_path(t.spark, "stream")
        jobs.append_to(df, f"{path}/out", f"{path}/checkpoint", once=True).awaitTermination()
        return t.spark.read.schema(df.schema).parquet(f"{path}/out")

    def updated(t: Tables, df: DataFrame, mode: str) -> DataFrame:
        path = fresh_path(t.spark, "stream")
        jobs.update_tables(df, f"{path}/out", f"{path}/checkpoint", mode, once=True).awaitTermination()
        return t.spark.read.parquet(f"{path}/out/*")

    def timeline(t: Tables) -> DataFrame:
        rows = updated(t, jobs.daily_timeline(stream(t), wide), "update")
        return jobs.current_states(rows, ["day"]).drop("batch_id")

    def active(t: Tables) -> DataFrame:
        rows = updated(t, jobs.workflow_states(stream(t), wide, idle_ms=90 * 86_400_000), "update")
        latest = jobs.current_states(rows, ["workflow_id"])
        return latest.filter(F.col("state") == "active").select("workflow_id", "steps")

    def rows(df: DataFrame) -> DataFrame:
        return df.select("event_id", "workflow_id", "timestamp", "activity", "status", "step_number")

    return {
        "streamed_append": lambda t: rows(finished(t, stream(t))),
        "streamed_tail": lambda t: finished(t, jobs.live_tail(stream(t), first_workflow(t))).select(
            "event_id", "activity"),
        "streamed_deduplicated": lambda t: rows(
            finished(t, jobs.without_duplicates(stream(t).union(stream(t)), wide))),
        "streamed_active": active,
        "streamed_timeline": timeline,
        "streamed_completions": lambda t: finished(
            t, jobs.completions_with_task(stream(t), t.workflow_embeddings)
        ).select("workflow_id", "task_description", "status"),
    }


def shop_queries() -> dict[str, Query]:
    def shop(t: Tables) -> Shop:
        return Shop(t.spark, t.sf_dir)

    def quotes(s: Shop) -> DataFrame:
        return rules.shipping_quotes(s.orders, s.products, s.customers, s.warehouses, s.shipping_rates)

    def totals(s: Shop) -> DataFrame:
        oid = F.col("order_id")
        rows = quotes(s).select(
            "order_id", "status", "loyalty_tier", (F.col("price") * F.col("quantity")).alias("subtotal"),
            F.when(oid % 11 == 0, 7.0).otherwise(rules.tier_discount(F.col("loyalty_tier"))).alias("discount_pct"),
            (oid % 3 * 5).cast("double").alias("promotion_discount"), "shipping_cost")
        right = money(F.col("subtotal") * (1 - F.col("discount_pct") / 100) - F.col("promotion_discount") + F.col("shipping_cost"))
        return rules.reconcile_totals(rows.withColumn("total", right + F.when(oid % 10 == 0, 0.5).otherwise(0.0)))

    def one_wallet(s: Shop) -> DataFrame:
        """A wallet that holds a third of all charges, beside the others."""
        payer = F.when(F.col("order_id") % 3 == 0, F.lit(-1)).otherwise(F.col("payment_id")).cast("bigint")
        rich = s.customers.limit(1).select(F.lit(-1).cast("bigint").alias("customer_id"), F.lit(1e9).alias("balance"))
        return rules.wallet_ledger(
            s.payments.withColumn("payment_id", payer), s.customers.select("customer_id", "balance").union(rich))

    def discounts(s: Shop) -> DataFrame:
        key = F.col("o_orderkey")
        asks = s.raw("orders").select(key, F.explode(F.array(F.lit(0), F.lit(1))).alias("s")).select(
            (key * 2 + F.col("s")).alias("request_id"), F.expr("o_orderkey div 2").alias("order_id"),
            ((key * 3 + F.col("s") * 5) % 60).alias("discount_percent"))
        return rules.apply_discounts(asks, s.orders)

    def risk(s: Shop) -> DataFrame:
        return rules.order_risk(s.orders, s.products, s.customer_flags)

    def assessments(s: Shop) -> DataFrame:
        first = risk(s).select("order_id", (F.col("order_id") * 2).alias("assessment_id"), "decision")
        overridden = first.filter(F.col("decision") == "review").select(
            "order_id", (F.col("assessment_id") + 1).alias("assessment_id"), F.lit("approve").alias("decision"))
        return rules.latest_assessments(first.unionByName(overridden))

    def history(s: Shop) -> DataFrame:
        tickets = s.raw("conversations").select(
            F.col("conv_id").alias("customer_id"), F.col("turn").alias("ticket_id"),
            F.col("text").alias("subject"))
        return rules.customer_history(s.orders, s.products, tickets)

    def search(s: Shop) -> DataFrame:
        articles = s.raw("documents").select(
            F.col("doc_id").alias("article_id"), F.concat_ws(" ", "source", "lang").alias("title"),
            F.array("lang", "source").alias("keywords"), F.col("text").alias("content"))
        return rules.keyword_search(articles, ["the tion fr", "und der src3", "les des src1"])

    def verified(s: Shop) -> DataFrame:
        oid = F.col("order_id")
        scenarios = s.orders.select(
            "order_id", F.when(oid % 2 == 0, "fulfilled").otherwise("pending").alias("expected_status"),
            F.when(oid % 5 == 0, oid + 1).alias("replacement_order_id"),
            F.when(oid % 5 == 0, "fulfilled").alias("expected_replacement"))
        return rules.verify_outcomes(scenarios, s.orders)

    def reach(s: Shop) -> DataFrame:
        wanted = s.orders.select(
            "order_id", "customer_id", F.when(F.col("order_id") % 2 == 0, "sms").otherwise("email").alias("channel"))
        return rules.reachability(wanted, s.customers)

    jobs_by_name: dict[str, Callable[[Shop], DataFrame]] = {
        "stock_locations": lambda s: rules.stock_locations(s.inventory, s.warehouses),
        "stock_checks": lambda s: rules.stock_checks(s.orders, s.inventory),
        "shipping_quotes": lambda s: quotes(s).select("order_id", "shipping_cost", "delivery_days"),
        "reconcile_totals": totals,
        "loyalty_discounts": lambda s: rules.loyalty_discounts(s.customers),
        "apply_discounts": discounts,
        "promotion_checks": lambda s: rules.promotion_checks(
            s.orders, s.products, s.customers, s.promotions, s.promotion_usage),
        "return_eligibility": lambda s: rules.return_eligibility(s.orders, s.products),
        "refund_eligibility": lambda s: rules.refund_eligibility(s.orders, s.refunds),
        "refund_batch": lambda s: rules.refund_batch(s.refund_requests, s.orders, s.refunds),
        "warranty": lambda s: rules.warranty(s.orders),
        "order_risk": risk,
        "compliance_requirements": lambda s: rules.compliance_requirements(
            s.orders, s.products, s.customer_flags).withColumn("requirements", F.col("requirements.type")),
        "latest_assessments": assessments,
        "customer_history": history,
        "customer_totals": lambda s: rules.customer_totals(s.customers, s.orders),
        "active_promotions": lambda s: rules.active_promotions(s.promotions),
        "promotion_usage": lambda s: s.promotion_usage.groupBy("promotion_id", "customer_id").agg(
            F.count("*").alias("uses")),
        "payment_methods": lambda s: rules.payment_methods(s.customers),
        "keyword_search": search,
        "restock": lambda s: rules.restock(s.inventory, s.restock_schedule),
        "net_stock": lambda s: rules.net_stock(s.inventory, s.reservations),
        "wallet_ledger_one_wallet": one_wallet,
        "wallet_ledger": lambda s: rules.wallet_ledger(s.payments, s.customers),
        "verify_outcomes": verified,
        "reachability": reach,
        "shipping_status": lambda s: rules.shipping_status(s.orders, s.tracking),
    }
    return {name: (lambda t, f=job: f(shop(t))) for name, job in jobs_by_name.items()}


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    collected: dict[str, Query] = {}
    for part in (
        dashboard_queries(), cluster_queries(), mining_queries(), operator_queries(), analysis_queries(),
        streaming_queries(), shop_queries(),
    ):
        collected.update(part)
    return {
        name: (lambda spark, sf_dir, f=function: tidy(f(load_tables(spark, sf_dir))))
        for name, function in collected.items()
    }
