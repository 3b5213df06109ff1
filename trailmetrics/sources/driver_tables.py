"""Adapter: derive an agent event log from the star-schema test tables.

one workflow, every row of ``events`` one tool call; start, mode and terminal
rows are added per workflow.  A derived table is written once per session to
the shared folder, the way an ingest job would store it, when the first query reads
it; queries read with column pruning and filter pushdown.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmetrics.operators.similarity import centroid
from trailmetrics.operators.traces import build_traces, most_frequent_sequence
from trailmetrics.session import materialize, ship_package
from trailmetrics.sources.schemas import COMPLETE, EVENT_COLUMNS, FAIL


@dataclass
class Tables:
    """The three core tables plus the raw driver tables by name.

    Each derived table is stored on first use, so a query pays for the tables it reads only.
    """

    spark: SparkSession
    sf_dir: str
    results: dict = field(default_factory=dict)  # analysis runs shared by several queries

    @cached_property
    def event_logs(self) -> DataFrame:
        return materialize(
            derive_event_logs(self.raw("events")).sortWithinPartitions("workflow_id", "step_number"), "event_logs"
        )

    @cached_property
    def workflow_embeddings(self) -> DataFrame:
        derived = derive_embeddings(self.event_logs, self.raw("embeddings"), self.raw("documents"))
        return materialize(derived.drop("label"), "workflow_embeddings")

    @cached_property
    def labels(self) -> DataFrame:
        """workflow_id -> label of its embedding, used as a planted cluster."""
        derived = derive_embeddings(self.event_logs, self.raw("embeddings"), self.raw("documents"))
        return materialize(derived.select("workflow_id", "label"), "labels")  # reads neither vectors nor texts

    @cached_property
    def optimal_paths(self) -> DataFrame:
        return materialize(
            derive_optimal_paths(self.event_logs, self.labels, self.raw("embeddings")), "optimal_paths"
        )

    @cached_property
    def traces(self) -> DataFrame:
        """Traces with their planted cluster, stored on first use."""
        built = build_traces(self.event_logs).join(self.labels, "workflow_id")
        return materialize(
            built.withColumn("task_cluster", F.concat(F.lit("cluster_"), "label")).drop("label"), "traces"
        )

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def number_steps(calls: DataFrame) -> DataFrame:
    """``step_number`` = rank of a call in its workflow by (ts, source_id).

    The rank is built in two levels, minute slices first and slice offsets
    second, so a workflow with a very large share of all rows is ranked by many
    tasks: no window partition holds more than one minute of one workflow or the
    2 880 slice counts of one workflow.
    """
    slice_id = (
        F.expr("unix_date(to_date(ts)) % 2") * 1440 + F.hour("ts") * 60 + F.minute("ts")
    )
    sliced = calls.withColumn("slice", slice_id)
    inside = Window.partitionBy("workflow_id", "slice").orderBy("ts", "source_id")
    ranked = sliced.withColumn("rank_in_slice", F.row_number().over(inside))
    counts = sliced.groupBy("workflow_id", "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("workflow_id").orderBy("slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.select(
        "workflow_id", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")
    )
    return (
        ranked.join(offsets, ["workflow_id", "slice"])
        .withColumn("step_number", (F.col("rank_in_slice") + F.col("ahead")).cast("int"))
        .drop("slice", "rank_in_slice", "ahead")
    )


def derive_event_logs(events: DataFrame) -> DataFrame:
    """Tool-call rows plus start, mode and terminal rows for every workflow."""
    k = F.get_json_object("props", "$.k").cast("int")
    calls = events.select(
        F.col("event_id").alias("source_id"),
        "ts",
        "user_id",
        F.expr("unix_date(to_date(ts)) div 2").alias("bucket"),
        F.col("event_type").alias("tool_name"),
        "props",
        k.alias("k"),
        F.round(F.col("value") * 10, 4).alias("duration_ms"),
    ).withColumn("workflow_id", F.concat_ws("-", "user_id", "bucket"))
    calls = calls.withColumn(
        "status",
        F.when(F.col("k") < 6, "failure")
        .when(F.col("k") == 6, "timeout")
        .when(F.col("k") == 7, "loop_detected")
        .otherwise("success"),
    )
    last_bucket = events.agg(
        F.max(F.expr("unix_date(to_date(ts)) div 2")).alias("b")
    ).first()["b"]

    none = F.lit(None).cast("string")
    tool_rows = number_steps(calls).select(
        F.concat(F.lit("e"), "source_id").alias("event_id"),
        "workflow_id",
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("tool_call:"), "tool_name").alias("activity"),
        F.concat(F.lit("agent_"), F.col("user_id") % 5).alias("agent_name"),
        F.when(F.col("user_id") % 3 == 0, "Guided worker").otherwise("worker").alias("agent_role"),
        "tool_name",
        F.col("props").alias("tool_parameters"),
        F.concat(
            F.lit('{"band": '), F.expr("k div 25"), F.lit(', "ok": '),
            F.when(F.col("status") == "success", "true").otherwise("false"), F.lit("}"),
        ).alias("tool_response"),
        F.concat(F.lit("model-"), F.col("user_id") % 2).alias("llm_model"),
        (F.col("k") * 10).alias("llm_prompt_tokens"),
        F.col("k").alias("llm_completion_tokens"),
        F.lit("").alias("llm_reasoning"),
        F.lit("").alias("llm_prompt"),
        "duration_ms",
        F.expr("cast(k / 1000.0 as decimal(10,6))").alias("cost_usd"),
        "status",
        F.when(F.col("status") != "success", F.concat(F.lit("error k="), "k")).alias("error_message"),
        "step_number",
        F.concat("workflow_id", F.lit(":start")).alias("parent_event_id"),
    )

    per_workflow = calls.groupBy("workflow_id", "user_id", "bucket").agg(
        F.min("ts").alias("t0"),
        F.max("ts").alias("t1"),
        F.count("*").cast("int").alias("n"),
        F.sum(F.col("duration_ms").cast("decimal(18,4)")).cast("double").alias("total_ms"),
        F.bool_or(F.col("status") != "success").alias("any_bad"),
    )
    user = F.col("user_id")
    zero = F.lit(0.0)

    def row(suffix, ts, activity, duration, status, step):
        return F.struct(
            F.lit(suffix).alias("suffix"), ts.alias("timestamp"), activity.alias("activity"),
            duration.alias("duration_ms"), status.alias("status"), step.alias("step_number"),
        )

    mode = F.when(user % 3 == 0, "optimize:guided").when(user % 3 == 1, "optimize:exploration")
    has_end = ~((user % 4 == 0) & (F.col("bucket") == last_bucket))
    end = F.when(
        has_end, F.when(F.col("any_bad"), F.lit(FAIL)).otherwise(F.lit(COMPLETE))
    )
    ok = F.lit("success")
    lifecycle = per_workflow.select(
        "workflow_id", "user_id",
        F.explode(F.array(
            row("start", F.col("t0"), F.lit("workflow:start"), zero, ok, F.lit(0)),
            row("mode", F.col("t0"), mode, zero, ok, F.lit(0)),
            row("end", F.col("t1"), end, F.col("total_ms"),
                F.when(F.col("any_bad"), "failure").otherwise("success"), F.col("n") + 1),
        )).alias("r"),
    ).filter(F.col("r.activity").isNotNull())
    hint = F.concat(
        F.lit("Task "), "workflow_id", F.lit("\n"),
        F.when(user % 2 == 0, "OPTIMIZATION HINT — ").otherwise("RECOMMENDED PATH: "),
        F.lit("follow run "), "workflow_id",
        F.when(user % 4 < 2, "\n\nYou are an agent.").otherwise(" </context> tail"),
    )
    lifecycle_rows = lifecycle.select(
        F.concat_ws(":", "workflow_id", "r.suffix").alias("event_id"),
        "workflow_id",
        "r.timestamp",
        "r.activity",
        F.concat(F.lit("agent_"), user % 5).alias("agent_name"),
        F.when(user % 3 == 0, "Guided worker").otherwise("worker").alias("agent_role"),
        none.alias("tool_name"),
        F.lit("{}").alias("tool_parameters"),
        F.lit("{}").alias("tool_response"),
        F.lit("").alias("llm_model"),
        F.lit(0).alias("llm_prompt_tokens"),
        F.lit(0).alias("llm_completion_tokens"),
        F.lit("").alias("llm_reasoning"),
        F.when(F.col("r.activity") == "optimize:guided", hint).otherwise(F.lit("")).alias("llm_prompt"),
        "r.duration_ms",
        F.lit(0).cast("decimal(10,6)").alias("cost_usd"),
        "r.status",
        none.alias("error_message"),
        "r.step_number",
        none.alias("parent_event_id"),
    )
    return tool_rows.select(*EVENT_COLUMNS).unionByName(lifecycle_rows.select(*EVENT_COLUMNS))


PULL = 3.0  # how far a run's vector is moved along its label's axis


def derive_embeddings(event_logs: DataFrame, embeddings: DataFrame, documents: DataFrame) -> DataFrame:
    """One embedding and one task description per workflow, dealt by the workflow's number.

    Numbers (bucket, then user) are dense, so all vectors and all whole documents are used as
    soon as there are as many workflows.  A vector is moved along the axis of its label, so
    that the runs of one label form a cluster of unequal vectors.
    """
    n_vectors = embeddings.count()
    n_documents = documents.count()
    started = event_logs.filter(F.col("activity") == "workflow:start").select(
        "workflow_id", F.col("timestamp").alias("created_at"),
        F.substring_index("workflow_id", "-", 1).cast("bigint").alias("user_id"),
        F.substring_index("workflow_id", "-", -1).cast("bigint").alias("bucket"),
    )
    users = (started.agg(F.max("user_id").alias("last")).first()["last"] or 0) + 1
    workflows = started.withColumn("number", F.col("bucket") * users + F.col("user_id"))
    kind = (
        F.when(F.col("user_id") % 4 == 0, "Exchange ")
        .when(F.col("user_id") % 4 == 1, "Return ")
        .when(F.col("user_id") % 4 == 2, "Fulfil ")
        .otherwise("Ask ")
    )
    texts = documents.select(F.col("doc_id").alias("doc_key"), "text")
    moved = F.transform(
        "embedding",
        lambda x, i: (x + F.when(i == F.col("label"), PULL).otherwise(0.0).cast("float")).cast("float"),
    )
    vectors = embeddings.select(F.col("vec_id").alias("vec_key"), moved.alias("embedding"), "label")
    return (
        workflows.withColumn("vec_key", F.col("number") % n_vectors)
        .withColumn("doc_key", F.col("number") % n_documents)
        .join(vectors, "vec_key")
        .join(texts, "doc_key")
        .select(
            "workflow_id",
            F.concat(kind, "text").alias("task_description"),
            "embedding",
            F.lit("driver-64d").alias("model_version"),
            "created_at",
            "label",
        )
    )


def derive_optimal_paths(
    event_logs: DataFrame, labels: DataFrame, embeddings: DataFrame
) -> DataFrame:
    """One path per embedding label: its centroid and most frequent sequence."""
    traces = materialize(build_traces(event_logs).join(labels, "workflow_id"), "labelled-traces")  # read twice
    stats = traces.groupBy("label").agg(
        F.avg("total_duration_ms").alias("avg_duration_ms"),
        F.avg("total_steps").alias("avg_steps"),
        F.avg(F.when(F.col("success"), 1.0).otherwise(0.0)).alias("success_rate"),
        F.count("*").alias("execution_count"),
        F.max("last_timestamp").alias("updated_at"),
        F.avg(F.when(F.col("is_guided") & F.col("n_terminal").cast("boolean"),
                     F.when(F.col("completed"), 1.0).otherwise(0.0))).alias("guided_success_rate"),
        F.avg(F.when(~F.col("is_guided") & F.col("n_terminal").cast("boolean"),
                     F.when(F.col("completed"), 1.0).otherwise(0.0))).alias("exploration_success_rate"),
    )
    name = (
        F.when(F.col("label") < 8, F.concat(
            F.lit("Group "), F.expr("label div 4"), F.lit(" (subcluster_"), F.col("label") % 4, F.lit(")")))
        .when(F.col("label") == 8, "Group 0")
        .otherwise(F.concat(F.lit("Solo "), "label"))
    )
    return (
        stats.join(most_frequent_sequence(traces, "label"), "label")
        .join(centroid(embeddings, "label"), "label")
        .select(
            F.concat(F.lit("path-"), "label").alias("path_id"),
            name.alias("task_cluster"),
            "tool_sequence",
            "avg_duration_ms", "avg_steps", "success_rate", "execution_count",
            F.col("centroid").alias("embedding"),
            "guided_success_rate", "exploration_success_rate",
            F.expr("cast(array() as array<string>)").alias("failure_warnings"),
            F.expr("cast(null as array<struct<tool_sequence:array<string>,execution_count:bigint,"
                   "success_rate:double,avg_steps:double>>)").alias("alternative_paths"),
            F.expr("cast(null as struct<common_prefix:array<string>,branch_tool:string,"
                   "condition_question:string,condition_key:string,branches:array<struct<"
                   "path:array<string>,execution_count:bigint,success_rate:double,"
                   "condition_value:string,label:string>>>)").alias("decision_tree"),
            "updated_at",
        )
    )


_LOADED: dict[tuple[str, str], Tables] = {}


def load_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The core tables, derived at most once per application and directory."""
    ship_package(spark)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LOADED:
        _LOADED[key] = Tables(spark, sf_dir)
    return _LOADED[key]
