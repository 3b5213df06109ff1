"""Oracle texts of the dashboard, cluster and guidance queries."""

from __future__ import annotations

from oracle.base import query

TS = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"


def ts(column: str) -> str:
    return TS.format(column)


def mode_stats(source: str) -> str:
    """Means per mode over terminal events of ``source`` joined with cost_map."""
    def part(prefix: str, flag: int) -> str:
        where = f"FILTER (WHERE e.is_guided = {flag})"
        return f"""
  round(avg(e.duration_ms) {where}, 4) AS {prefix}_avg_duration,
  round(avg(e.step_number) {where}, 4) AS {prefix}_avg_steps,
  round(avg(CASE WHEN e.status = 'success' THEN 1.0 ELSE 0.0 END) {where}, 4) AS {prefix}_success_rate,
  count(*) {where} AS {prefix}_count,
  round(avg(c.total_cost_usd) {where}, 4) AS {prefix}_avg_cost"""
    return f"SELECT {part('exp', 0)}, {part('gui', 1)} FROM {source} e LEFT JOIN cost_map c USING (workflow_id)"


TOOL_ROWS = """
SELECT tool_name, count(*) AS call_count, round(avg(duration_ms), 4) AS avg_duration_ms,
  round(CAST(sum(cost_usd) AS DOUBLE), 4) AS total_cost_usd,
  round(CAST(count(*) AS DOUBLE) / nullif(count(DISTINCT workflow_id), 0), 4) AS avg_calls_per_workflow
FROM tool_events {where} GROUP BY tool_name"""

EDGE_ROWS = """
SELECT source, target, count(*) AS weight FROM (
  SELECT lag(tool_name) OVER (PARTITION BY workflow_id ORDER BY step_number, timestamp, event_id) AS source, tool_name AS target
  FROM tool_events {where}) WHERE source IS NOT NULL GROUP BY ALL"""

NODE_ROWS = """
SELECT tool_name AS id, round(avg(duration_ms), 4) AS avg_duration_ms, count(*) AS call_count
FROM tool_events {where} GROUP BY tool_name"""


def matched(ids: str) -> str:
    return f"SELECT workflow_id, any_value(task_description) AS task_description, max(similarity) AS similarity FROM similarities WHERE path_id IN ({ids}) AND similarity >= 0.15 GROUP BY workflow_id"


IN_MATCHED = "WHERE workflow_id IN (SELECT workflow_id FROM matched)"
ONE = matched("'path-3'")
GROUP = matched("SELECT path_id FROM optimal_paths WHERE task_cluster = 'Group 0' OR (task_cluster LIKE 'Group 0 (subcluster!_%)' ESCAPE '!')")


def workflows_of(match: str) -> str:
    return query(f"""
SELECT m.workflow_id, m.task_description, round(m.similarity, 4) AS similarity, e.status, round(e.duration_ms, 4) AS duration_ms,
  CAST(e.step_number AS BIGINT) AS steps, {ts('e.timestamp')} AS timestamp,
  CASE WHEN e.is_guided = 1 THEN 'guided' ELSE 'exploration' END AS mode, round(c.total_cost_usd, 4) AS cost_usd
FROM matched m JOIN terminal e USING (workflow_id) LEFT JOIN cost_map c USING (workflow_id)""", matched=match)


def conformance_of(match: str, paths: str) -> str:
    return query("""
SELECT round(avg(best), 4) AS avg_conformance FROM (
  SELECT s.workflow_id, max(CAST(len(list_filter(range(1, least(len(s.tools), len(p.tool_sequence)) + 1), lambda i: s.tools[i] = p.tool_sequence[i])) AS DOUBLE)
      / greatest(len(s.tools), len(p.tool_sequence))) AS best
  FROM seqs s, chosen p GROUP BY s.workflow_id)""",
        matched=match,
        seqs=f"SELECT workflow_id, list(tool_name ORDER BY step_number, timestamp, event_id) AS tools FROM tool_events {IN_MATCHED} GROUP BY workflow_id",
        chosen=f"SELECT tool_sequence FROM optimal_paths WHERE {paths}")


IN_GROUP = "(task_cluster = 'Group 0' OR task_cluster LIKE 'Group 0 (subcluster!_%)' ESCAPE '!')"

GUIDE = {
    "eligible": "SELECT * FROM optimal_paths WHERE execution_count >= 30 AND success_rate >= 0.6",
    "nearest": """SELECT workflow_id, path_id, similarity FROM similarities WHERE path_id IN (SELECT path_id FROM eligible)
QUALIFY row_number() OVER (PARTITION BY workflow_id ORDER BY round(similarity, 9) DESC, path_id) = 1""",
    "decided": """SELECT w.workflow_id, n.similarity, p.*,
  CASE WHEN p.path_id IS NULL THEN 'no_matching_paths' WHEN n.similarity < 0.15 THEN 'below_threshold'
       WHEN p.guided_success_rate < p.exploration_success_rate - 0.04 THEN 'regression_detected' ELSE 'guided' END AS reason
FROM workflow_embeddings w LEFT JOIN nearest n USING (workflow_id) LEFT JOIN eligible p ON p.path_id = n.path_id""",
}

MATCH = {
    "seqs": "SELECT DISTINCT tool_sequence FROM traces WHERE len(tool_sequence) > 0",
    "scored": """SELECT s.tool_sequence, p.path_id, p.task_cluster, p.tool_sequence AS optimal_sequence, p.avg_duration_ms AS optimal_duration_ms,
  p.avg_steps AS optimal_steps, p.success_rate AS optimal_success_rate, p.execution_count,
  CAST(len(list_filter(range(1, least(len(s.tool_sequence), len(p.tool_sequence)) + 1), lambda i: s.tool_sequence[i] = p.tool_sequence[i])) AS DOUBLE)
    / least(len(s.tool_sequence), len(p.tool_sequence)) AS score
FROM seqs s, optimal_paths p
QUALIFY row_number() OVER (PARTITION BY s.tool_sequence ORDER BY score DESC, execution_count DESC, task_cluster) = 1""",
    "best_match": """SELECT *, list_transform(range(1, len(tool_sequence) + 1), lambda i: CASE WHEN i > len(optimal_sequence) THEN 'extra'
  WHEN tool_sequence[i] = optimal_sequence[i] THEN 'match' ELSE 'deviation' END) AS alignment FROM scored""",
}

PER_RUN = """
SELECT e.workflow_id, coalesce(m.is_guided, 0) AS is_guided,
  max(duration_ms) FILTER (WHERE activity IN ('workflow:complete', 'workflow:fail')) AS duration_ms,
  max(step_number) FILTER (WHERE activity IN ('workflow:complete', 'workflow:fail')) AS steps,
  max(status) FILTER (WHERE activity IN ('workflow:complete', 'workflow:fail')) AS status,
  CAST(sum(cost_usd) AS DOUBLE) AS cost
FROM event_logs e LEFT JOIN mode_map m USING (workflow_id) GROUP BY ALL"""

ORACLES: dict[str, str] = {
    "analytics_summary": query("""
SELECT count(DISTINCT workflow_id) AS total_workflows, count(*) AS total_events,
  round(avg(duration_ms) FILTER (WHERE activity IN ('workflow:complete', 'workflow:fail')), 4) AS avg_duration_ms,
  round(avg(step_number) FILTER (WHERE activity IN ('workflow:complete', 'workflow:fail')), 4) AS avg_steps,
  round(avg(CASE WHEN status = 'success' THEN 1.0 ELSE 0.0 END) FILTER (WHERE activity IN ('workflow:complete', 'workflow:fail')), 4) AS success_rate
FROM event_logs"""),
    "analytics_top_tools": query("""
SELECT tool_name, count(*) AS call_count, round(avg(duration_ms), 4) AS avg_duration_ms
FROM event_logs WHERE tool_name IS NOT NULL GROUP BY tool_name ORDER BY call_count DESC, tool_name LIMIT 10"""),
    "workflow_trace": query(f"""
SELECT e.event_id, e.workflow_id, {ts('e.timestamp')} AS timestamp, e.activity, e.tool_name, e.status,
  round(e.duration_ms, 4) AS duration_ms, CAST(e.step_number AS BIGINT) AS step_number, w.task_description
FROM event_logs e LEFT JOIN workflow_embeddings w USING (workflow_id)
WHERE e.workflow_id = (SELECT min(workflow_id) FROM event_logs)"""),
    "list_workflows": query(f"""
SELECT t.workflow_id, t.status, round(t.duration_ms, 4) AS duration_ms, CAST(t.step_number AS BIGINT) AS steps,
  {ts('t.timestamp')} AS timestamp, w.task_description,
  CASE WHEN EXISTS (SELECT 1 FROM event_logs g WHERE g.workflow_id = t.workflow_id AND g.activity = 'optimize:guided') THEN 'guided' ELSE 'exploration' END AS mode
FROM terminal t LEFT JOIN workflow_embeddings w USING (workflow_id)
ORDER BY t.timestamp DESC, t.workflow_id LIMIT 50 OFFSET 10"""),
    "list_workflows_far": query(f"""
SELECT t.workflow_id, t.status, round(t.duration_ms, 4) AS duration_ms, CAST(t.step_number AS BIGINT) AS steps,
  {ts('t.timestamp')} AS timestamp, w.task_description,
  CASE WHEN EXISTS (SELECT 1 FROM event_logs g WHERE g.workflow_id = t.workflow_id AND g.activity = 'optimize:guided') THEN 'guided' ELSE 'exploration' END AS mode
FROM terminal t LEFT JOIN workflow_embeddings w USING (workflow_id)
ORDER BY t.timestamp DESC, t.workflow_id LIMIT 40 OFFSET 300"""),
    "list_workflows_total": query("SELECT count(*) AS total FROM terminal"),
    "list_optimal_paths": query(f"""
SELECT task_cluster, array_to_string(tool_sequence, '>') AS tool_sequence, round(avg_duration_ms, 4) AS avg_duration_ms,
  round(avg_steps, 4) AS avg_steps, round(success_rate, 4) AS success_rate, execution_count, {ts('updated_at')} AS updated_at
FROM optimal_paths"""),
    "list_active_workflows": query(f"""
SELECT e.workflow_id, w.task_description, 'in_progress' AS status, CAST(NULL AS DOUBLE) AS duration_ms,
  CAST(max(e.step_number) AS BIGINT) AS steps, {ts('min(e.timestamp)')} AS timestamp,
  bool_or(e.activity = 'optimize:guided') AS is_guided
FROM event_logs e LEFT JOIN workflow_embeddings w USING (workflow_id)
WHERE e.workflow_id IN (SELECT workflow_id FROM event_logs WHERE activity = 'workflow:start'
  EXCEPT SELECT workflow_id FROM event_logs WHERE activity IN ('workflow:complete', 'workflow:fail'))
GROUP BY e.workflow_id, w.task_description"""),
    "mode_distribution": query("""
SELECT count(*) FILTER (WHERE is_guided = 1) AS guided, count(*) FILTER (WHERE is_guided = 0) AS exploration, count(*) AS total FROM terminal"""),
    "mode_comparison": query(mode_stats("terminal")),
    "timeline": query("""
SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS date, count(*) AS workflows, round(avg(duration_ms), 4) AS avg_duration_ms,
  round(avg(CASE WHEN status = 'success' THEN 1.0 ELSE 0.0 END), 4) AS success_rate, round(avg(is_guided), 4) AS guided_pct
FROM terminal GROUP BY 1"""),
    "execution_graph_nodes": query(NODE_ROWS.format(where="")),
    "execution_graph_edges": query(EDGE_ROWS.format(where="")),
    "bottlenecks": query(TOOL_ROWS.format(where="")),
    "savings": query("""
SELECT round((xd - gd) * n, 4) AS time_saved_ms, round((xc - gc) * n, 4) AS cost_saved_usd,
  CASE WHEN xd = 0 THEN 0.0 ELSE round((xd - gd) / xd * 100, 2) END AS pct_duration_improvement,
  CASE WHEN xs = 0 THEN 0.0 ELSE round((xs - gs) / xs * 100, 2) END AS pct_steps_improvement,
  CASE WHEN 1 - xr = 0 THEN 0.0 ELSE round(((1 - xr) - (1 - gr)) / (1 - xr) * 100, 2) END AS pct_success_improvement,
  n AS guided_count
FROM (SELECT
  coalesce(avg(duration_ms) FILTER (WHERE is_guided = 0), 0) AS xd, coalesce(avg(duration_ms) FILTER (WHERE is_guided = 1), 0) AS gd,
  coalesce(avg(steps) FILTER (WHERE is_guided = 0), 0) AS xs, coalesce(avg(steps) FILTER (WHERE is_guided = 1), 0) AS gs,
  coalesce(avg(CASE WHEN status = 'success' THEN 1.0 ELSE 0.0 END) FILTER (WHERE is_guided = 0), 0) AS xr,
  coalesce(avg(CASE WHEN status = 'success' THEN 1.0 ELSE 0.0 END) FILTER (WHERE is_guided = 1), 0) AS gr,
  coalesce(avg(cost) FILTER (WHERE is_guided = 0), 0) AS xc, coalesce(avg(cost) FILTER (WHERE is_guided = 1), 0) AS gc,
  count(*) FILTER (WHERE is_guided = 1) AS n FROM per_run)""", per_run=PER_RUN),
    "guided_readiness": query("""
SELECT task_cluster, execution_count, round(success_rate, 2) AS success_rate,
  CASE WHEN execution_count >= 200 THEN 'GUIDED READY' ELSE 'NEED ' || (200 - execution_count) || ' MORE' END AS status
FROM optimal_paths"""),
    "runs_by_type": query("""
SELECT CASE WHEN task_description ILIKE '%exchange%' THEN 'exchange' WHEN task_description ILIKE '%return%' THEN 'return'
  WHEN task_description ILIKE '%fulfil%' THEN 'fulfilment' ELSE 'other' END AS workflow_type,
  count(*) AS total_runs, count(*) FILTER (WHERE activity = 'workflow:complete') AS successes,
  count(*) FILTER (WHERE activity = 'workflow:fail') AS failures
FROM workflow_embeddings JOIN terminal USING (workflow_id) GROUP BY 1"""),
    "mode_breakdown": query("""
SELECT replace(activity, 'optimize:', '') AS mode, count(*) AS n FROM event_logs
WHERE activity IN ('optimize:guided', 'optimize:exploration') GROUP BY 1"""),
    "performance_over_time": query(f"""
SELECT mode, {ts('timestamp')} AS timestamp, workflow_id, event_id, round(seconds, 4) AS seconds,
  round(avg(seconds) OVER (PARTITION BY mode ORDER BY timestamp, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS rolling_avg
FROM (SELECT CASE WHEN is_guided = 1 THEN 'guided' ELSE 'exploration' END AS mode, timestamp, workflow_id, event_id,
  coalesce(duration_ms, 0) / 1000 AS seconds FROM terminal)"""),
    "performance_axes": query(f"""
SELECT {ts('min(timestamp)')} AS x_min, {ts('max(timestamp)')} AS x_max, CAST(ceil(max(duration_ms / 1000) * 1.15) AS BIGINT) AS y_max,
  round(avg(duration_ms / 1000) FILTER (WHERE is_guided = 0), 4) AS exploration_mean,
  round(avg(duration_ms / 1000) FILTER (WHERE is_guided = 1), 4) AS guided_mean,
  {ts('min(timestamp) FILTER (WHERE is_guided = 1)')} AS first_guided FROM terminal"""),
    "cost_leaks": query("""
SELECT row_number() OVER (ORDER BY total_cost_usd DESC, tool_name) AS rank, tool_name, round(total_cost_usd, 4) AS cost,
  round(total_cost_usd / max(total_cost_usd) OVER () * 100, 4) AS bar_pct, avg_calls_per_workflow > 2 AS redundant FROM tool_stats"""),
    "bottleneck_quadrant": query("""
SELECT tool_name, call_count, round(avg_duration_ms, 4) AS avg_duration_ms, mc AS median_calls, round(md, 4) AS median_ms,
  call_count >= mc AND avg_duration_ms >= md AS is_hot
FROM tool_stats, (SELECT list_sort(list(call_count))[len(list(call_count)) // 2 + 1] AS mc,
  list_sort(list(avg_duration_ms))[len(list(avg_duration_ms)) // 2 + 1] AS md FROM tool_stats)"""),
    "trace_timeline": query("""
SELECT workflow_id, CAST(step_number AS BIGINT) AS step_number, tool_name, status,
  round(coalesce(sum(greatest(duration_ms, 50)) OVER (PARTITION BY workflow_id ORDER BY step_number, timestamp, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS start_ms, round(greatest(duration_ms, 50), 4) AS bar_ms
FROM event_logs WHERE tool_name IS NOT NULL"""),
    "insights_summary": query("""
SELECT round(sum(total_cost_usd), 4) AS total_cost_usd, count(*) FILTER (WHERE avg_calls_per_workflow > 2) AS redundant_tools,
  (SELECT tool_name FROM tool_stats ORDER BY avg_duration_ms DESC, tool_name LIMIT 1) AS slowest_tool,
  (SELECT tool_name FROM tool_stats ORDER BY call_count DESC, tool_name LIMIT 1) AS most_called_tool FROM tool_stats"""),
    "guided_share": query("""
SELECT round(100.0 * count(*) FILTER (WHERE is_guided = 1) / count(*), 4) AS guided_pct,
  round(100.0 * count(*) FILTER (WHERE is_guided = 0) / count(*), 4) AS exploration_pct FROM terminal"""),
    "comparison_cards": query("""
SELECT CASE WHEN is_guided = 1 THEN 'guided' ELSE 'exploration' END AS mode, round(avg(duration_ms) / 1000, 1) AS seconds,
  round(avg(step_number), 1) AS steps, round(avg(CASE WHEN status = 'success' THEN 1.0 ELSE 0.0 END) * 100, 1) AS success_pct,
  round(avg(total_cost_usd) * 100, 2) AS cents
FROM terminal LEFT JOIN cost_map USING (workflow_id) GROUP BY 1"""),
    "task_clusters": query(f"""
SELECT p.path_id, p.task_cluster, array_to_string(p.tool_sequence, '>') AS tool_sequence, round(p.avg_duration_ms, 4) AS avg_duration_ms,
  round(p.avg_steps, 4) AS avg_steps, round(p.success_rate, 4) AS success_rate, p.execution_count, {ts('p.updated_at')} AS updated_at,
  p.execution_count AS workflow_count,
  (SELECT s.task_description FROM similarities s WHERE s.path_id = p.path_id AND s.similarity >= 0.15
   ORDER BY round(s.similarity, 9) DESC, s.workflow_id LIMIT 1) AS task_description
FROM optimal_paths p"""),
    "task_clusters_grouped": query(r"""
SELECT name, coalesce(max(execution_count) FILTER (WHERE name = task_cluster), CAST(sum(execution_count) AS BIGINT)) AS total_workflows,
  count(*) AS members, round(sum(avg_duration_ms * execution_count) / sum(execution_count), 4) AS avg_duration_ms,
  round(sum(success_rate * execution_count) / sum(execution_count), 4) AS success_rate
FROM (SELECT *, regexp_replace(task_cluster, '\s*\(subcluster_\d+\)$', '') AS name FROM optimal_paths) GROUP BY name"""),
    "task_clusters_grouped_page": query(r"""
SELECT name, coalesce(max(execution_count) FILTER (WHERE name = task_cluster), CAST(sum(execution_count) AS BIGINT)) AS total_workflows,
  count(*) AS members, round(sum(avg_duration_ms * execution_count) / sum(execution_count), 4) AS avg_duration_ms,
  round(sum(success_rate * execution_count) / sum(execution_count), 4) AS success_rate
FROM (SELECT *, regexp_replace(task_cluster, '\s*\(subcluster_\d+\)$', '') AS name FROM optimal_paths) GROUP BY name ORDER BY total_workflows DESC, name LIMIT 3 OFFSET 2"""),
    "cluster_detail": workflows_of(ONE),
    "cluster_mode_stats": query(mode_stats(f"(SELECT * FROM terminal {IN_MATCHED})"), matched=ONE),
    "cluster_conformance": conformance_of(ONE, "path_id = 'path-3'"),
    "cluster_execution_graph_nodes": query(NODE_ROWS.format(where=IN_MATCHED), matched=ONE),
    "cluster_execution_graph_edges": query(EDGE_ROWS.format(where=IN_MATCHED), matched=ONE),
    "cluster_bottlenecks": query(TOOL_ROWS.format(where=IN_MATCHED), matched=ONE),
    "group_detail": workflows_of(GROUP),
    "group_mode_stats": query(mode_stats(f"(SELECT * FROM terminal {IN_MATCHED})"), matched=GROUP),
    "group_conformance": conformance_of(GROUP, IN_GROUP),
    "group_overview": query(f"""
SELECT CAST(sum(execution_count) AS BIGINT) AS total_workflows, count(*) FILTER (WHERE task_cluster <> 'Group 0') AS variants,
  round(sum(avg_duration_ms * execution_count) / sum(execution_count), 4) AS avg_duration_ms,
  round(sum(avg_steps * execution_count) / sum(execution_count), 4) AS avg_steps,
  round(sum(success_rate * execution_count) / sum(execution_count), 4) AS success_rate,
  array_to_string(coalesce(any_value(tool_sequence) FILTER (WHERE task_cluster = 'Group 0'),
    arg_max(tool_sequence, (success_rate, execution_count))), '>') AS optimal_sequence
FROM optimal_paths WHERE {IN_GROUP}"""),
    "group_distinct_paths": query(f"""
SELECT array_to_string(tools, '>') AS tool_sequence, count(*) AS workflow_count FROM (
  SELECT workflow_id, list(tool_name ORDER BY timestamp, step_number, event_id) AS tools FROM tool_events {IN_MATCHED} GROUP BY workflow_id)
GROUP BY tools""", matched=GROUP),
    "group_execution_graph_nodes": query(NODE_ROWS.format(where=IN_MATCHED), matched=GROUP),
    "group_execution_graph_edges": query(EDGE_ROWS.format(where=IN_MATCHED), matched=GROUP),
    "group_bottlenecks": query(TOOL_ROWS.format(where=IN_MATCHED), matched=GROUP),
    "group_best_variants": query(r"""
SELECT name, arg_max(task_cluster, (success_rate, execution_count, task_cluster)) AS best_variant,
  arg_max(task_cluster, (len(tool_sequence), task_cluster)) AS longest_variant, max(len(tool_sequence)) AS longest_steps
FROM (SELECT *, regexp_replace(task_cluster, '\s*\(subcluster_\d+\)$', '') AS name FROM optimal_paths) GROUP BY name"""),
    "fetch_group_path_ids": query(f"SELECT path_id FROM optimal_paths WHERE {IN_GROUP}"),
    "similar_paths": query("SELECT workflow_id, path_id, round(similarity, 4) AS similarity FROM nearest", **{k: GUIDE[k] for k in ("eligible", "nearest")}),
    "guidance": query("""
SELECT workflow_id, CASE WHEN reason = 'guided' THEN 'guided' ELSE 'exploration' END AS mode, reason,
  CASE WHEN reason = 'guided' THEN array_to_string(tool_sequence, '>') END AS path,
  CASE WHEN reason = 'guided' THEN round(similarity, 4) END AS confidence,
  CASE WHEN reason = 'guided' THEN round(avg_duration_ms, 4) END AS avg_duration_ms,
  CASE WHEN reason = 'guided' THEN round(avg_steps, 4) END AS avg_steps,
  CASE WHEN reason = 'guided' THEN round(success_rate, 4) END AS success_rate,
  CASE WHEN reason = 'guided' THEN execution_count END AS execution_count FROM decided""", **GUIDE),
    "guidance_text": query("""
SELECT workflow_id, CASE WHEN reason = 'guided' THEN
  'OPTIMIZATION HINT — This tool sequence has worked well for similar tasks:' || chr(10)
  || array_to_string(list_transform(range(1, len(tool_sequence) + 1), lambda i: '  ' || i || '. ' || tool_sequence[i]), chr(10)) || chr(10)
  || 'Based on ' || execution_count || ' runs (' || CAST(round(success_rate * 100) AS INTEGER) || '% success rate).' || chr(10)
  || chr(10) || 'GUIDELINES:' || chr(10) || '- Use this as a suggested approach — adapt if the situation requires it.'
  || chr(10) || '- After each tool, check the response to decide which branch to follow.'
  || chr(10) || '- Skip steps that are already complete.'
  || chr(10) || '- If a tool returns an error, reason about what to do next — do not retry the same call.' ELSE '' END AS guidance_text FROM decided""", **GUIDE),
    "best_path_match": query("""
SELECT array_to_string(tool_sequence, '>') AS tool_sequence, round(score, 4) AS score, path_id, array_to_string(alignment, '>') AS alignment FROM best_match""", **MATCH),
    "optimization_context": query("""
SELECT t.workflow_id, b.task_cluster, round(b.score * 100) AS conformance_pct,
  round(CAST(len(list_filter(b.alignment, lambda x: x = 'match')) AS DOUBLE) / len(b.alignment) * 100) AS aligned_pct,
  CASE WHEN round(CAST(len(list_filter(b.alignment, lambda x: x = 'match')) AS DOUBLE) / len(b.alignment) * 100) >= 80 THEN 'high'
    WHEN round(CAST(len(list_filter(b.alignment, lambda x: x = 'match')) AS DOUBLE) / len(b.alignment) * 100) >= 50 THEN 'medium' ELSE 'low' END AS band,
  array_to_string(b.alignment, ',') AS alignment,
  round(CASE WHEN optimal_duration_ms = 0 THEN 0 ELSE (optimal_duration_ms - t.total_duration_ms) / optimal_duration_ms * 100 END, 4) AS duration_vs_optimal,
  round(CASE WHEN optimal_steps = 0 THEN 0 ELSE (optimal_steps - t.total_steps) / optimal_steps * 100 END, 4) AS steps_vs_optimal,
  round(CASE WHEN t.success THEN 100.0 ELSE 0.0 END - optimal_success_rate * 100, 4) AS success_vs_optimal,
  round((xd - t.total_duration_ms) / xd * 100, 4) AS duration_vs_exploration,
  round((xs - t.total_steps) / xs * 100, 4) AS steps_vs_exploration,
  round(CASE WHEN t.success THEN 100.0 ELSE 0.0 END - xr * 100, 4) AS success_vs_exploration, has_guided
FROM traces t JOIN best_match b USING (tool_sequence),
  (SELECT avg(duration_ms) FILTER (WHERE is_guided = 0) AS xd, avg(step_number) FILTER (WHERE is_guided = 0) AS xs,
     avg(CASE WHEN status = 'success' THEN 1.0 ELSE 0.0 END) FILTER (WHERE is_guided = 0) AS xr,
     count(*) FILTER (WHERE is_guided = 1) > 0 AS has_guided FROM terminal)""", **MATCH),
}
