"""Common table expressions shared by the oracle queries.

``query(body)`` puts in front of a body exactly those expressions it refers to.
"""

from __future__ import annotations

import re

CTES: dict[str, str] = {}

CTES["calls"] = """
SELECT event_id AS source_id, ts, user_id, event_type AS tool_name, props,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
  date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) // 2 AS bucket,
  CAST(user_id AS VARCHAR) || '-' || CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) // 2 AS VARCHAR) AS workflow_id,
  round(value * 10, 4) AS duration_ms,
  CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) < 6 THEN 'failure'
       WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) = 6 THEN 'timeout'
       WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) = 7 THEN 'loop_detected'
       ELSE 'success' END AS status
FROM events"""

CTES["runs"] = """
SELECT workflow_id, user_id, bucket, min(ts) AS t0, max(ts) AS t1, CAST(count(*) AS INTEGER) AS n,
  CAST(sum(CAST(duration_ms AS DECIMAL(18,4))) AS DOUBLE) AS total_ms,
  bool_or(status <> 'success') AS any_bad
FROM calls GROUP BY ALL"""

CTES["event_logs"] = """
SELECT 'e' || source_id AS event_id, workflow_id, ts AS timestamp, 'tool_call:' || tool_name AS activity,
  'agent_' || (user_id % 5) AS agent_name,
  CASE WHEN user_id % 3 = 0 THEN 'Guided worker' ELSE 'worker' END AS agent_role,
  tool_name, props AS tool_parameters,
  '{"band": ' || (k // 25) || ', "ok": ' || CASE WHEN status = 'success' THEN 'true' ELSE 'false' END || '}' AS tool_response,
  'model-' || (user_id % 2) AS llm_model, k * 10 AS llm_prompt_tokens, k AS llm_completion_tokens,
  '' AS llm_reasoning, '' AS llm_prompt, duration_ms,
  CAST(k / 1000.0 AS DECIMAL(10,6)) AS cost_usd, status,
  CASE WHEN status <> 'success' THEN 'error k=' || k END AS error_message,
  CAST(row_number() OVER (PARTITION BY workflow_id ORDER BY ts, source_id) AS INTEGER) AS step_number,
  workflow_id || ':start' AS parent_event_id
FROM calls
UNION ALL
SELECT workflow_id || ':' || suffix, workflow_id, timestamp, activity,
  'agent_' || (user_id % 5), CASE WHEN user_id % 3 = 0 THEN 'Guided worker' ELSE 'worker' END,
  NULL, '{}', '{}', '', 0, 0, '',
  CASE WHEN activity = 'optimize:guided' THEN 'Task ' || workflow_id || chr(10)
    || CASE WHEN user_id % 2 = 0 THEN 'OPTIMIZATION HINT — ' ELSE 'RECOMMENDED PATH: ' END
    || 'follow run ' || workflow_id
    || CASE WHEN user_id % 4 < 2 THEN chr(10) || chr(10) || 'You are an agent.' ELSE ' </context> tail' END
    ELSE '' END,
  duration_ms, CAST(0 AS DECIMAL(10,6)), status, NULL, step_number, NULL
FROM (
  SELECT workflow_id, user_id, 'start' AS suffix, t0 AS timestamp, 'workflow:start' AS activity, 0.0::DOUBLE AS duration_ms, 'success' AS status, 0 AS step_number FROM runs
  UNION ALL
  SELECT workflow_id, user_id, 'mode', t0, CASE user_id % 3 WHEN 0 THEN 'optimize:guided' ELSE 'optimize:exploration' END, 0.0::DOUBLE, 'success', 0 FROM runs WHERE user_id % 3 < 2
  UNION ALL
  SELECT workflow_id, user_id, 'end', t1, CASE WHEN any_bad THEN 'workflow:fail' ELSE 'workflow:complete' END,
    total_ms, CASE WHEN any_bad THEN 'failure' ELSE 'success' END, n + 1
  FROM runs WHERE NOT (user_id % 4 = 0 AND bucket = (SELECT max(bucket) FROM runs))
)"""

CTES["members"] = """
SELECT r.workflow_id, r.user_id, v.label, r.t0 AS created_at,
  list_transform(v.embedding, lambda x, i: CAST(x + CAST(CASE WHEN i = v.label + 1 THEN 3 ELSE 0 END AS FLOAT) AS FLOAT)) AS embedding,
  CASE r.user_id % 4 WHEN 0 THEN 'Exchange ' WHEN 1 THEN 'Return ' WHEN 2 THEN 'Fulfil ' ELSE 'Ask ' END
    || d.text AS task_description
FROM (SELECT *, bucket * (SELECT max(user_id) + 1 FROM runs) + user_id AS number FROM runs) r
JOIN embeddings v ON v.vec_id = r.number % (SELECT count(*) FROM embeddings)
JOIN documents d ON d.doc_id = r.number % (SELECT count(*) FROM documents)"""

CTES["workflow_embeddings"] = """
SELECT workflow_id, task_description, embedding, 'driver-64d' AS model_version, created_at FROM members"""

CTES["traces"] = """
SELECT workflow_id,
  coalesce(list(tool_name ORDER BY step_number, timestamp, event_id) FILTER (WHERE tool_name IS NOT NULL), []) AS tool_sequence,
  coalesce(arg_min(duration_ms, step_number) FILTER (WHERE activity = 'workflow:complete' AND duration_ms > 0),
           sum(duration_ms) FILTER (WHERE tool_name IS NOT NULL), 0) AS total_duration_ms,
  sum(cost_usd) AS total_cost_usd,
  count(tool_name) AS total_steps,
  bool_or(activity = 'workflow:complete' AND status = 'success') AS success,
  bool_or(activity = 'workflow:complete') AS completed,
  bool_or(activity = 'optimize:guided') AS is_guided,
  count(*) FILTER (WHERE activity IN ('workflow:complete', 'workflow:fail')) AS n_terminal,
  min(timestamp) AS first_timestamp, max(timestamp) AS last_timestamp
FROM event_logs GROUP BY workflow_id"""

CTES["labelled"] = """
SELECT t.*, m.label FROM traces t JOIN members m USING (workflow_id)"""

CTES["centroids"] = """
SELECT label, list(mean ORDER BY pos) AS centroid FROM (
  SELECT label, pos, avg(CAST(x AS DOUBLE)) AS mean
  FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)
  GROUP BY label, pos) GROUP BY label"""

CTES["sequence_counts"] = """
SELECT label, tool_sequence, count(*) AS n FROM labelled WHERE len(tool_sequence) > 0 GROUP BY ALL"""

CTES["common_sequences"] = """
SELECT label, tool_sequence FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, tool_sequence) AS rn FROM sequence_counts)
WHERE rn = 1"""

CTES["optimal_paths"] = """
SELECT 'path-' || s.label AS path_id,
  CASE WHEN s.label < 8 THEN 'Group ' || (s.label // 4) || ' (subcluster_' || (s.label % 4) || ')'
       WHEN s.label = 8 THEN 'Group 0' ELSE 'Solo ' || s.label END AS task_cluster,
  c.tool_sequence, s.avg_duration_ms, s.avg_steps, s.success_rate, s.execution_count,
  v.centroid AS embedding, s.guided_success_rate, s.exploration_success_rate, s.updated_at
FROM (SELECT label, avg(total_duration_ms) AS avg_duration_ms, avg(total_steps) AS avg_steps,
        avg(CASE WHEN success THEN 1.0 ELSE 0.0 END) AS success_rate, count(*) AS execution_count,
        avg(CASE WHEN completed THEN 1.0 ELSE 0.0 END) FILTER (WHERE is_guided AND n_terminal > 0) AS guided_success_rate,
        avg(CASE WHEN completed THEN 1.0 ELSE 0.0 END) FILTER (WHERE NOT is_guided AND n_terminal > 0) AS exploration_success_rate,
        max(last_timestamp) AS updated_at
      FROM labelled GROUP BY label) s
JOIN common_sequences c USING (label) JOIN centroids v USING (label)"""

CTES["mode_map"] = """
SELECT workflow_id, max(CASE WHEN activity = 'optimize:guided' THEN 1 ELSE 0 END) AS is_guided
FROM event_logs WHERE activity IN ('optimize:guided', 'optimize:exploration') GROUP BY workflow_id"""

CTES["cost_map"] = """
SELECT workflow_id, CAST(sum(cost_usd) AS DOUBLE) AS total_cost_usd FROM event_logs GROUP BY workflow_id"""

CTES["terminal"] = """
SELECT e.*, coalesce(m.is_guided, 0) AS is_guided FROM event_logs e LEFT JOIN mode_map m USING (workflow_id)
WHERE activity IN ('workflow:complete', 'workflow:fail')"""

CTES["tool_events"] = """
SELECT * FROM event_logs WHERE tool_name IS NOT NULL AND activity LIKE 'tool_call:%'"""

CTES["tool_stats"] = """
SELECT tool_name, count(*) AS call_count, avg(duration_ms) AS avg_duration_ms,
  CAST(sum(cost_usd) AS DOUBLE) AS total_cost_usd,
  CAST(count(*) AS DOUBLE) / nullif(count(DISTINCT workflow_id), 0) AS avg_calls_per_workflow
FROM tool_events GROUP BY tool_name"""

CTES["similarities"] = """
SELECT w.workflow_id, w.task_description, p.path_id, p.task_cluster, p.tool_sequence,
  list_cosine_similarity(CAST(w.embedding AS DOUBLE[]), p.embedding) AS similarity
FROM workflow_embeddings w, optimal_paths p"""

# Moves between tools of a run, with start and end sentinels, in trace order.
CTES["moves"] = """
SELECT workflow_id, tool_name AS source,
  coalesce(lead(tool_name) OVER (PARTITION BY workflow_id ORDER BY step_number, timestamp, event_id), '__END__') AS target
FROM event_logs WHERE tool_name IS NOT NULL
UNION ALL
SELECT workflow_id, '__START__', tool_name FROM event_logs WHERE tool_name IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY workflow_id ORDER BY step_number, timestamp, event_id) = 1"""

CTES["moves_by_time"] = CTES["moves"].replace(
    "ORDER BY step_number, timestamp, event_id", "ORDER BY timestamp, step_number, event_id"
)

CTES["last_calls"] = """
SELECT workflow_id, tool_name, duration_ms, cost_usd FROM event_logs WHERE tool_name IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY workflow_id, tool_name ORDER BY step_number DESC, timestamp DESC, event_id DESC) = 1"""

# Clusters of the mining oracles: the label of a run's embedding.
CTES["clustered"] = """
SELECT 'cluster_' || label AS task_cluster, * EXCLUDE (label) FROM labelled"""

CTES["edges"] = """
SELECT c.task_cluster, m.source, m.target, count(*) AS frequency,
  avg(CASE WHEN c.success THEN 1.0 ELSE 0.0 END) AS success_rate,
  avg(coalesce(l.duration_ms, 0)) AS avg_duration_ms, CAST(sum(coalesce(l.cost_usd, 0)) AS DOUBLE) / count(*) AS avg_cost_usd
FROM moves m JOIN clustered c USING (workflow_id)
LEFT JOIN last_calls l ON l.workflow_id = m.workflow_id AND l.tool_name = m.target
GROUP BY ALL"""

# Names that are worth computing once.
STORED = {"event_logs", "traces", "members", "optimal_paths", "similarities", "subclustered", "leveled", "ranked"}


def needed(text: str, extra: dict[str, str]) -> list[str]:
    """Names of the expressions a text refers to, dependencies first."""
    known = {**CTES, **extra}
    found: list[str] = []

    def visit(body: str, names: dict[str, str], open_names: tuple[str, ...]) -> None:
        plain = re.sub(r"'[^']*'", "''", body)
        for name in names:
            if name in found or name in open_names or not re.search(rf"\b{name}\b", plain):
                continue
            inner = known if name in extra else CTES
            visit(known[name], inner, (*open_names, name))
            found.append(name)

    visit(text, known, ())
    return found


def settle_ties(text: str) -> str:
    """``round(x, 4)`` -> ``round(x + 1e-9, 4)``: exact ties round up in every engine.

    The Spark side does the same when it prepares its output.
    """
    out, at = "", 0
    for call in re.finditer(r"\bround\(", text):
        depth, end = 1, call.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        tail = re.search(r",\s*4$", text[call.end(): end - 1])
        if tail:
            cut = call.end() + tail.start()
            out += text[at:cut] + " + 1e-9"
            at = cut
    return out + text[at:]


def query(body: str, **extra: str) -> str:
    """Full query text; ``extra`` adds expressions local to this query.

    A local expression that refers to itself makes the query recursive.
    """
    body = settle_ties(body)
    known = {**CTES, **extra}
    recursive = any(re.search(rf"\b{n}\b", t) for n, t in extra.items())
    parts = []
    for name in needed(body, extra):
        stored = " MATERIALIZED" if name in STORED else ""
        parts.append(f"{name} AS{stored} ({known[name].strip()})")
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(parts) + "\n" if parts else "") + body.strip()
