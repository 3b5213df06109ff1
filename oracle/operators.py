"""Oracle texts of the single operators: ingest, predicates, joins, windows, functions."""

from __future__ import annotations

from oracle.base import query
from oracle.dashboards import ts

# Raw events as ingest sees them: some fields missing or wrong, by event id.
RAW = """SELECT *, event_id % 5 AS shape,
  CASE event_id % 5 WHEN 1 THEN 'nonsense' WHEN 4 THEN NULL ELSE 'success' END AS raw_status,
  CASE event_id % 5 WHEN 2 THEN '  ' ELSE 'tool_call:' || event_type END AS raw_activity FROM events"""

# The clusters planted by the adapter: one per label.
PLANTED = """
SELECT min(workflow_id) AS first_workflow, count(*) AS workflows, min(task_description) AS first_description
FROM members GROUP BY label HAVING count(*) >= 5"""

ORACLES: dict[str, str] = {
    "normalised_events": query("""
SELECT CAST(event_id AS VARCHAR) AS event_id, raw_activity AS activity, event_type AS tool_name, coalesce(raw_status, 'success') AS status,
  CASE WHEN shape = 3 THEN 0.0 ELSE round(value, 4) END AS duration_ms, CAST(0 AS BIGINT) AS step_number, '{}' AS tool_response, '' AS llm_model
FROM raw WHERE shape NOT IN (1, 2)""", raw=RAW),
    "rejected_events": query("""
SELECT CAST(event_id AS VARCHAR) AS event_id, CASE shape WHEN 1 THEN 'bad status' ELSE 'blank activity' END AS reason FROM raw WHERE shape IN (1, 2)""", raw=RAW),
    "workflow_ids": query("SELECT DISTINCT workflow_id FROM event_logs"),
    "workflow_events": query("""
SELECT event_id, activity, CAST(step_number AS BIGINT) AS step_number FROM event_logs WHERE workflow_id = (SELECT min(workflow_id) FROM event_logs)"""),
    "task_lookup": query("""
SELECT workflow_id, task_description, len(embedding) AS dimensions FROM workflow_embeddings WHERE workflow_id = (SELECT min(workflow_id) FROM event_logs)"""),
    "embedding_scan": query("""
SELECT vec_id, len(embedding) AS dimensions, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings WHERE label <> 3"""),
    "upserted_embeddings": query("""
SELECT workflow_id, task_description, CASE WHEN user_id % 2 = 0 THEN 'second' ELSE 'driver-64d' END AS model_version FROM members
UNION ALL SELECT 'new-' || workflow_id, 'fresh', 'second' FROM members WHERE user_id % 2 = 0"""),
    "replaced_paths": query("""
SELECT task_cluster, CASE WHEN execution_count >= 200 THEN 0 ELSE execution_count END AS execution_count FROM optimal_paths"""),
    "stored_paths_replaced": query("""
SELECT task_cluster, CASE WHEN execution_count >= 200 THEN 0 ELSE execution_count END AS execution_count, CAST(2 AS BIGINT) AS version FROM optimal_paths"""),
    "stored_paths_versions": query("""
SELECT CAST(1 AS BIGINT) AS version, task_cluster, execution_count FROM optimal_paths
UNION ALL SELECT 3, task_cluster, 0 FROM optimal_paths WHERE execution_count >= 200"""),
    "stored_paths_after_failure": query("SELECT task_cluster, execution_count, CAST(1 AS BIGINT) AS version FROM optimal_paths"),
    "appended_events": query(f"SELECT event_id, workflow_id, {ts('timestamp')} AS timestamp, activity, status, CAST(step_number AS BIGINT) AS step_number FROM event_logs"),
    "reanalysed_after_stream": query("""
SELECT raw_activity AS activity, coalesce(raw_status, 'success') AS status, count(*) AS n,
  round(CAST(sum(CASE WHEN shape = 3 THEN 0 ELSE value END) AS DOUBLE), 4) AS total_ms
FROM raw WHERE shape NOT IN (1, 2) GROUP BY ALL""", raw=RAW),
    "purged_events": query("""
SELECT event_id, workflow_id, activity FROM event_logs WHERE workflow_id NOT IN (SELECT workflow_id FROM event_logs WHERE activity = 'optimize:guided')"""),
    "purged_embeddings": query("""
SELECT workflow_id FROM workflow_embeddings WHERE workflow_id NOT IN (SELECT workflow_id FROM event_logs WHERE activity = 'optimize:guided')"""),
    "event_log_frame": query(f"""
SELECT workflow_id AS case_id, tool_name AS activity, {ts('timestamp')} AS timestamp FROM event_logs WHERE tool_name IS NOT NULL"""),
    "step_outcomes": query("""
SELECT CAST(source_id AS VARCHAR) AS event_id, CASE WHEN k < 10 THEN 'failure' ELSE 'success' END AS status, CASE WHEN k < 10 THEN 'bad ' || k END AS error_message,
  CASE WHEN k < 10 THEN '{"error":"bad ' || k || '"}' WHEN k < 50 THEN '{"output":"plain ' || k || '"}' ELSE '{"k":' || k || '}' END AS tool_response FROM calls"""),
    "agent_cascade": query("""
SELECT CAST(source_id AS VARCHAR) AS event_id, CASE WHEN k % 3 = 0 THEN 'step-' || k WHEN k % 2 = 0 THEN 'trace-' || k ELSE 'default-agent' END AS agent FROM calls"""),
    "tool_call_filter": query("SELECT count(*) AS n, round(sum(duration_ms), 4) AS total_ms FROM event_logs WHERE tool_name IS NOT NULL AND activity LIKE 'tool_call:%'"),
    "trace_headers": query("""
SELECT workflow_id, round(sum(duration_ms), 4) AS total_duration_ms, round(CAST(sum(cost_usd) AS DOUBLE), 4) AS total_cost_usd,
  CAST(sum(llm_prompt_tokens + llm_completion_tokens) AS BIGINT) AS total_tokens, count(tool_name) AS tool_steps,
  CASE WHEN bool_or(status = 'failure') THEN 'failure' WHEN bool_or(status = 'timeout') THEN 'timeout' ELSE 'success' END AS overall_status,
  CASE WHEN bool_or(status = 'failure') THEN 'failure' WHEN NOT bool_or(activity IN ('workflow:complete', 'workflow:fail')) THEN 'in_progress' ELSE 'success' END AS live_status
FROM event_logs GROUP BY workflow_id"""),
    "mode_by_role": query("""
SELECT workflow_id, CASE WHEN lower(agent_role) LIKE '%guided%' THEN 'guided' ELSE 'exploration' END AS mode FROM event_logs
QUALIFY row_number() OVER (PARTITION BY workflow_id ORDER BY step_number, timestamp, event_id) = 1"""),
    "merged_workflow_list": query(f"""
SELECT CAST(0 AS BIGINT) AS section, workflow_id, 'in_progress' AS status, CAST(max(step_number) AS BIGINT) AS steps, {ts('min(timestamp)')} AS timestamp FROM event_logs
WHERE workflow_id NOT IN (SELECT workflow_id FROM terminal) GROUP BY workflow_id
UNION ALL SELECT 1, workflow_id, status, step_number, {ts('timestamp')} FROM terminal"""),
    "merged_events": query("SELECT event_id, workflow_id, activity, CAST(step_number AS BIGINT) AS step_number FROM event_logs"),
    "parent_links": query("""
SELECT e.event_id, e.parent_event_id, p.activity AS parent_activity FROM event_logs e LEFT JOIN event_logs p ON p.event_id = e.parent_event_id
WHERE e.parent_event_id IS NOT NULL"""),
    "round_summary": query("""
SELECT CAST(round AS VARCHAR) AS round, mode, count(*) AS runs, count(*) FILTER (WHERE status = 'success') AS successes, round(avg(step_number), 4) AS avg_steps,
  round(avg(duration_ms), 4) AS avg_duration_ms, CAST(sum(tokens) AS BIGINT) AS tokens
FROM (SELECT *, CAST(timestamp AS DATE) AS round, CASE WHEN is_guided = 1 THEN 'guided' ELSE 'exploration' END AS mode FROM terminal
  JOIN (SELECT workflow_id, sum(llm_prompt_tokens + llm_completion_tokens) AS tokens FROM event_logs GROUP BY 1) USING (workflow_id))
GROUP BY ROLLUP (round, mode)"""),
    "drawn_edges": query("""
SELECT source, target, weight, greatest(1.0, round(weight / (SELECT max(weight) FROM trans) * 5)) AS width,
  EXISTS (SELECT 1 FROM (SELECT tool_sequence, unnest(range(1, len(tool_sequence))) AS i FROM optimal_paths) p
    WHERE p.tool_sequence[i] = t.source AND p.tool_sequence[i + 1] = t.target) AS on_path
FROM trans t WHERE source <> target""",
        trans="SELECT source, target, count(*) AS weight FROM moves WHERE source <> '__START__' AND target <> '__END__' GROUP BY ALL"),
    "optimal_edges": query("""
SELECT DISTINCT tool_sequence[i] AS source, tool_sequence[i + 1] AS target FROM (SELECT tool_sequence, unnest(range(1, len(tool_sequence))) AS i FROM optimal_paths)"""),
    "tool_differences": query("""
SELECT c.workflow_id, array_to_string(list_sort(list_filter(list_distinct(c.tool_sequence), lambda t: NOT list_contains(b.tool_sequence, t))), '>') AS extra_tools,
  list_sort(list_distinct(c.tool_sequence)) = list_sort(list_distinct(b.tool_sequence)) AS same_tools
FROM clustered c JOIN (SELECT 'cluster_' || label AS task_cluster, tool_sequence FROM common_sequences) b USING (task_cluster)"""),
    "mode_success_rates": query("""
SELECT task_cluster, round(avg(CASE WHEN completed THEN 1.0 ELSE 0.0 END) FILTER (WHERE is_guided AND n_terminal > 0), 4) AS guided_success_rate,
  round(avg(CASE WHEN completed THEN 1.0 ELSE 0.0 END) FILTER (WHERE NOT is_guided AND n_terminal > 0), 4) AS exploration_success_rate
FROM clustered GROUP BY 1"""),
    "centroids": query("SELECT CAST(label AS BIGINT) AS label, pos - 1 AS pos, round(x, 4) AS x FROM (SELECT label, unnest(centroid) AS x, generate_subscripts(centroid, 1) AS pos FROM centroids)"),
    "cosine_to_centroid": query("""
SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), centroid), 4) AS similarity FROM embeddings JOIN centroids USING (label)"""),
    "similar_workflow_pairs": query("SELECT workflow_id, path_id, round(similarity, 4) AS similarity FROM similarities WHERE similarity >= 0.15"),
    "similar_run_pairs": query("""
SELECT a.workflow_id, b.workflow_id AS path_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS similarity
FROM members a JOIN members b ON a.workflow_id < b.workflow_id
WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.95"""),
    "edit_distance_to_path": query("""
SELECT c.workflow_id, levenshtein(coded, best) AS edits, round(CASE WHEN length(coded) + length(best) = 0 THEN 0 ELSE 2.0 * levenshtein(coded, best) / (length(coded) + length(best)) END, 4) AS ned
FROM (SELECT workflow_id, task_cluster, array_to_string(list_transform(tool_sequence, lambda t: t[1:1]), '') AS coded FROM clustered) c
JOIN (SELECT 'cluster_' || label AS task_cluster, array_to_string(list_transform(tool_sequence, lambda t: t[1:1]), '') AS best FROM common_sequences) USING (task_cluster)"""),
    "near_sequences": query("""
SELECT array_to_string(a.seq, '>') AS a, array_to_string(b.seq, '>') AS b, levenshtein(a.coded, b.coded) AS edits
FROM coded a JOIN coded b ON a.seq < b.seq WHERE levenshtein(a.coded, b.coded) <= 1""",
        coded="SELECT DISTINCT tool_sequence AS seq, array_to_string(list_transform(tool_sequence, lambda t: t[1:1]), '') AS coded FROM traces"),
    "common_prefixes": query("""
SELECT task_cluster, n AS n_seq, coalesce((SELECT min(pos) - 1 FROM positions p WHERE p.task_cluster = s.task_cluster AND NOT same), shortest) AS prefix_length
FROM (SELECT 'starts ' || tool_sequence[1] AS task_cluster, count(*) AS n, min(len(tool_sequence)) AS shortest FROM traces WHERE len(tool_sequence) > 0 GROUP BY 1) s""",
        positions="""SELECT task_cluster, pos, count(*) = any_value(n) AND count(DISTINCT tool) = 1 AS same FROM (
  SELECT 'starts ' || tool_sequence[1] AS task_cluster, unnest(tool_sequence) AS tool, generate_subscripts(tool_sequence, 1) AS pos,
    (SELECT count(*) FROM traces o WHERE o.tool_sequence[1] = t.tool_sequence[1]) AS n FROM traces t WHERE len(tool_sequence) > 0) GROUP BY task_cluster, pos"""),
    "collapsed_sequences": query("""
SELECT workflow_id, array_to_string(list_filter(list_transform(range(1, len(tool_sequence) + 1), lambda i: CASE WHEN i = 1 OR tool_sequence[i] <> tool_sequence[i - 1] THEN tool_sequence[i] END), lambda x: x IS NOT NULL), '>') AS collapsed
FROM traces"""),
    "first_responses": query("""
SELECT workflow_id, tool_name, tool_response FROM event_logs WHERE tool_name IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY workflow_id, tool_name ORDER BY step_number, timestamp, event_id) = 1"""),
    "parameter_values": query("""
SELECT tool_name, 'k' AS param, json_extract_string(tool_parameters, '$.k') AS value, count(*) AS n FROM event_logs WHERE tool_name IS NOT NULL GROUP BY ALL"""),
    "retries": query("""
SELECT workflow_id, CAST(step_number AS BIGINT) AS step_number, tool_name FROM (SELECT *, lead(tool_name) OVER (PARTITION BY workflow_id ORDER BY step_number, timestamp, event_id) AS nxt FROM event_logs)
WHERE status = 'failure' AND tool_name = nxt"""),
    "guidance_blocks": query("""
SELECT workflow_id, CASE WHEN CAST(split_part(workflow_id, '-', 1) AS BIGINT) % 2 = 0 THEN 'OPTIMIZATION HINT — follow run ' ELSE 'RECOMMENDED PATH: follow run ' END || workflow_id AS block
FROM event_logs WHERE activity = 'optimize:guided'"""),
    "cluster_labels": query(r"""
SELECT task_cluster, regexp_replace(task_cluster, '\s*\(subcluster_\d+\)$', '') AS parent,
  CASE WHEN regexp_matches(task_cluster, '\(subcluster_\d+\)$') THEN 'Variant ' || (CAST(regexp_extract(task_cluster, 'subcluster_(\d+)', 1) AS INTEGER) + 1) ELSE task_cluster END AS variant,
  task_cluster[1:5] AS head FROM optimal_paths"""),
    "tool_labels": query("""
SELECT event_id, upper(p[1:1]) || lower(substring(p, 2)) AS humanised, array_to_string(list_transform(string_split(p, ' '), lambda w: upper(w[1:1]) || lower(substring(w, 2))), ' ') AS titled,
  CASE WHEN length(activity) > 12 THEN activity[1:12] || '…' ELSE activity END AS short
FROM (SELECT event_id, replace(tool_name || '_of_' || agent_name, '_', ' ') AS p, activity FROM event_logs WHERE tool_name IS NOT NULL)"""),
    "formatted_runs": query("""
SELECT workflow_id, CASE WHEN duration_ms < 1000 THEN CAST(floor(duration_ms + 0.5) AS BIGINT) || 'ms' ELSE format('{:.1f}', duration_ms / 1000 + 1e-9) || 's' END AS duration,
  CASE WHEN c.total_cost_usd < 0.01 THEN '$' || format('{:.4f}', c.total_cost_usd + 1e-9) ELSE '$' || format('{:.2f}', c.total_cost_usd + 1e-9) END AS cost,
  strftime(timestamp, '%d %b, %H:%M') AS at, format('{:,}', CAST(floor(duration_ms) AS BIGINT)) AS whole_ms,
  format('{:.1f}', (duration_ms / 10000 + 1e-9) * 100) || '%' AS share,
  CASE WHEN duration_ms < 500 THEN 'fast' WHEN duration_ms < 2000 THEN 'medium' ELSE 'slow' END AS band,
  CASE WHEN duration_ms = 0 THEN '-' ELSE CASE WHEN (duration_ms - 1000) / duration_ms * 100 > 0 THEN '↓' ELSE '↑' END || CAST(round(abs((duration_ms - 1000) / nullif(duration_ms, 0) * 100) + 1e-9) AS BIGINT) || '%' END AS delta,
  CASE WHEN duration_ms - 1000 = 0 THEN 'neutral' WHEN duration_ms - 1000 > 0 THEN 'good' ELSE 'bad' END AS verdict
FROM terminal JOIN cost_map c USING (workflow_id)"""),
    "node_sizes": query("""
SELECT tool_name, round(greatest(4, least(18, sqrt(total_cost_usd * 10000) * 0.4)), 4) AS radius FROM tool_stats"""),
    "primary_paths": query("""
SELECT task_cluster, array_to_string(tool_sequence, '>') AS tool_sequence, runs AS primary_runs, n - 1 AS alternatives, alternative_runs
FROM (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY task_cluster) AS n,
    CAST(sum(runs) OVER (PARTITION BY task_cluster) - runs AS BIGINT) AS alternative_runs FROM shapes WINDOW w AS (PARTITION BY task_cluster ORDER BY runs DESC, subcluster)) WHERE rn = 1""",
        counted="SELECT 'starts ' || tool_sequence[1] AS task_cluster, coalesce('then ' || tool_sequence[2], 'ends') AS subcluster, tool_sequence, count(*) AS n FROM traces WHERE len(tool_sequence) > 0 GROUP BY ALL",
        shapes="""SELECT task_cluster, subcluster, arg_min(tool_sequence, (-n, tool_sequence)) AS tool_sequence, CAST(sum(n) AS BIGINT) AS runs FROM counted GROUP BY ALL"""),
    "cluster_by_embedding": query(PLANTED),
    "cluster_by_embedding_in_blocks": query(PLANTED),
    "cluster_names": query("""
SELECT 'cluster_' || label AS cluster_label, arg_min(task_description, (length(task_description), task_description))[1:60] AS task_cluster FROM members GROUP BY 1"""),
    "streamed_timeline": query("""
SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS day, count(*) AS workflows, round(avg(duration_ms), 4) AS avg_duration_ms,
  round(avg(CASE WHEN status = 'success' THEN 1.0 ELSE 0.0 END), 4) AS success_rate
FROM event_logs WHERE activity IN ('workflow:complete', 'workflow:fail') GROUP BY 1"""),
    "streamed_append": query(f"SELECT event_id, workflow_id, {ts('timestamp')} AS timestamp, activity, status, CAST(step_number AS BIGINT) AS step_number FROM event_logs"),
    "streamed_tail": query("SELECT event_id, activity FROM event_logs WHERE workflow_id = (SELECT min(workflow_id) FROM event_logs)"),
    "streamed_deduplicated": query(f"SELECT event_id, workflow_id, {ts('timestamp')} AS timestamp, activity, status, CAST(step_number AS BIGINT) AS step_number FROM event_logs"),
    "streamed_completions": query("""
SELECT w.workflow_id, w.task_description, t.status FROM terminal t JOIN workflow_embeddings w USING (workflow_id)"""),
    "streamed_active": query("""
SELECT workflow_id, CAST(max(step_number) AS BIGINT) AS steps FROM event_logs WHERE workflow_id NOT IN (SELECT workflow_id FROM terminal) GROUP BY 1"""),
}
