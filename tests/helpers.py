"""Small event logs for tests."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

from trailmetrics.sources.schemas import EVENT_COLUMNS, EVENT_LOG_DDL

DEFAULTS = {
    "agent_name": "agent", "agent_role": "worker", "tool_name": None, "tool_parameters": "{}",
    "tool_response": "{}", "llm_model": "", "llm_prompt_tokens": 0, "llm_completion_tokens": 0,
    "llm_reasoning": "", "llm_prompt": "", "duration_ms": 0.0, "cost_usd": "0", "status": "success",
    "error_message": None, "step_number": 0, "parent_event_id": None,
}


def event(workflow, step, activity, **given):
    row = {**DEFAULTS, **given}
    row.update(
        event_id=given.get("event_id", f"{workflow}-{step}-{activity}"), workflow_id=workflow,
        timestamp=given.get("timestamp", datetime(2024, 1, 1) + timedelta(seconds=step)),
        activity=activity, step_number=step,
    )
    return row


def run(workflow, tools, success=True, ms=100.0, cost="0.001", mode=None, end=True, params=None, responses=None,
        statuses=None, total_ms=None):
    """Events of one run; ``tools`` may be a string of one-letter tool names."""
    tools = list(tools)
    rows = [event(workflow, 0, "workflow:start")]
    if mode:
        rows.append(event(workflow, 0, f"optimize:{mode}"))
    for i, tool in enumerate(tools, 1):
        rows.append(event(
            workflow, i, f"tool_call:{tool}", tool_name=tool, duration_ms=float(ms[i - 1] if isinstance(ms, list) else ms),
            cost_usd=cost, tool_parameters=json.dumps((params or {}).get(tool, {})),
            tool_response=json.dumps((responses or {}).get(tool, {})), status=(statuses or {}).get(i, "success")))
    if end:
        total = total_ms if total_ms is not None else float(sum(ms) if isinstance(ms, list) else ms * len(tools))
        rows.append(event(
            workflow, len(tools) + 1, "workflow:complete" if success else "workflow:fail",
            duration_ms=total, status="success" if success else "failure"))
    return rows


def log(spark, *runs):
    from decimal import Decimal

    rows = [r for one in runs for r in one]
    data = [tuple(Decimal(r[c]) if c == "cost_usd" else r[c] for c in EVENT_COLUMNS) for r in rows]
    return spark.createDataFrame(data, EVENT_LOG_DDL)


def members(spark, event_logs, cluster="c"):
    from pyspark.sql import functions as F

    from trailmetrics.operators.traces import build_traces

    return build_traces(event_logs).withColumn("task_cluster", F.lit(cluster))
