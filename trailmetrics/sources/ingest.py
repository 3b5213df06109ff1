"""Event ingest: normalisation, validation, status from responses, append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmetrics.sources.schemas import EVENT_COLUMNS, STATUSES

# What a missing optional field becomes.
DEFAULTS = {
    "tool_parameters": "{}", "tool_response": "{}", "llm_model": "", "llm_prompt_tokens": "0",
    "llm_completion_tokens": "0", "llm_reasoning": "", "llm_prompt": "", "duration_ms": "0.0",
    "cost_usd": "0.0", "status": "success", "step_number": "0",
}
TYPES = {
    "llm_prompt_tokens": "int", "llm_completion_tokens": "int", "duration_ms": "double",
    "cost_usd": "decimal(10,6)", "step_number": "int", "timestamp": "timestamp_ntz",
}
REQUIRED = ("event_id", "workflow_id", "timestamp", "activity", "agent_name", "agent_role")
UUID = r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in EVENT_COLUMNS])


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON text -> one string column per event field; the text stays as ``raw``."""
    return lines.select(
        F.col(column).alias("raw"), F.from_json(column, RAW_SCHEMA).alias("e")
    ).select("raw", "e.*")


def rejection_reason(strict_ids: bool = True) -> Column:
    """Why an event is refused, NULL for a good one (first reason wins)."""
    checks = [
        F.when(F.col(name).isNull(), F.lit(f"missing {name}")) for name in REQUIRED
    ]
    if strict_ids:
        checks += [
            F.when(~F.col(name).rlike(UUID), F.lit(f"bad {name}"))
            for name in ("event_id", "workflow_id", "parent_event_id")
        ]
    checks += [
        F.when(F.trim("activity") == "", F.lit("blank activity")),
        F.when(F.col("timestamp").try_cast("timestamp_ntz").isNull(), F.lit("bad timestamp")),
        F.when(~F.col("status").isin(*STATUSES), F.lit("bad status")),
    ]
    checks += [
        F.when(F.col(name).isNotNull() & F.col(name).try_cast(t).isNull(), F.lit(f"bad {name}"))
        for name, t in TYPES.items() if name != "timestamp"
    ]
    return F.coalesce(*checks)


def normalise(events: DataFrame) -> DataFrame:
    """Defaults for missing optional fields, typed columns, lower-case ids; idempotent.

    ``tool_name``, ``error_message`` and ``parent_event_id`` stay NULL when missing;
    an empty parent id means none.
    """
    out = []
    for name in EVENT_COLUMNS:
        c = F.col(name)
        if name in DEFAULTS:
            c = F.coalesce(c.cast("string"), F.lit(DEFAULTS[name]))
        if name in ("event_id", "workflow_id"):
            c = F.lower(c)
        if name == "parent_event_id":
            c = F.lower(F.nullif(c, F.lit("")))
        if name in TYPES:
            c = c.cast(TYPES[name])
        out.append(c.alias(name))
    return events.select(*out)


def validate(events: DataFrame, strict_ids: bool = True) -> tuple[DataFrame, DataFrame]:
    """(accepted and normalised events, refused events with ``reason``)."""
    judged = events.withColumn("reason", rejection_reason(strict_ids))
    accepted = normalise(judged.filter(F.col("reason").isNull()))
    return accepted, judged.filter(F.col("reason").isNotNull())


def append_events(events: DataFrame, path: str) -> int:
    """Append a batch, partitioned by day and sorted by workflow; an empty batch
    writes nothing.  Returns the number of events written."""
    n = events.count()
    if n:
        (
            events.withColumn("event_date", F.to_date("timestamp"))
            .sortWithinPartitions("event_date", "workflow_id", "step_number")
            .write.mode("append").partitionBy("event_date").parquet(path)
        )
    return n


def read_events(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*EVENT_COLUMNS)


def step_outcome(response: Column) -> tuple[Column, Column, Column]:
    """(status, error_message, response) from a tool's answer.

    A JSON object with an ``error`` key is a failure with that message; any other
    answer is a success, and one that is no JSON object is wrapped as
    ``{"output": ...}``.
    """
    parsed = F.try_parse_json(response)
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    is_error = is_object & F.array_contains(F.json_object_keys(response), "error")
    message = F.get_json_object(response, "$.error")
    wrapped = F.to_json(F.struct(response.alias("output")))
    return (
        F.when(is_error, "failure").otherwise("success"),
        F.when(is_error, message),
        F.when(F.coalesce(is_object, F.lit(False)), response).otherwise(wrapped),
    )


def with_step_outcome(calls: DataFrame, column: str = "tool_response") -> DataFrame:
    status, message, answer = step_outcome(F.col(column))
    return calls.withColumn("status", status).withColumn("error_message", message).withColumn(column, answer)


def effective_agent(step: Column, trace: Column, default: str) -> Column:
    """Step override, else trace override, else the client default; '' counts as unset."""
    empty = F.lit("")
    return F.coalesce(F.nullif(step, empty), F.nullif(trace, empty), F.lit(default))


def event_log_frame(event_logs: DataFrame) -> DataFrame:
    """(case_id, activity, timestamp) of all rows with a tool name."""
    return event_logs.filter(F.col("tool_name").isNotNull()).select(
        F.col("workflow_id").alias("case_id"), F.col("tool_name").alias("activity"), "timestamp"
    )


def workflow_events(event_logs: DataFrame, workflow_id: str) -> DataFrame:
    return event_logs.filter(F.col("workflow_id") == workflow_id).orderBy("step_number", "timestamp")


def workflow_ids(event_logs: DataFrame) -> DataFrame:
    return event_logs.select("workflow_id").distinct().orderBy("workflow_id")


def task_of(embeddings: DataFrame, workflow_id: str) -> DataFrame:
    """Description and embedding of one workflow."""
    return embeddings.filter(F.col("workflow_id") == workflow_id).select(
        "workflow_id", "task_description", "embedding"
    )


def steps_with_parent(event_logs: DataFrame) -> DataFrame:
    """Each event with a parent id, with the parent's activity; a parent that does not
    exist leaves it NULL."""
    parents = event_logs.select(
        F.col("event_id").alias("parent_event_id"), F.col("activity").alias("parent_activity")
    )
    return event_logs.filter(F.col("parent_event_id").isNotNull()).join(parents, "parent_event_id", "left")
