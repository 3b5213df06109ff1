"""Oracle texts of the process-mining queries."""

from __future__ import annotations

import re

from oracle.base import CTES, query

# ---- process model over successful runs, by time -----------------------------------
MODEL = {
    "model": """SELECT c.task_cluster, m.source, m.target, count(*) AS frequency FROM moves_by_time m JOIN clustered c USING (workflow_id)
WHERE c.success GROUP BY ALL HAVING count(*) >= 10""",
    "checked": """SELECT * FROM (SELECT c.task_cluster, m.workflow_id, m.source, m.target, d.source IS NOT NULL AS allowed
FROM moves_by_time m JOIN clustered c USING (workflow_id) LEFT JOIN model d ON d.task_cluster = c.task_cluster AND d.source = m.source AND d.target = m.target)
WHERE task_cluster IN (SELECT task_cluster FROM model)""",
}

# ---- path search ---------------------------------------------------------------------
MIN_SUCCESS = 0.5
SEARCH = {
    "good": f"SELECT * FROM edges WHERE success_rate >= {MIN_SUCCESS}",
    "walk": """SELECT task_cluster, [target] AS seq, target AS last FROM good WHERE source = '__START__' AND target <> '__END__'
UNION ALL
SELECT w.task_cluster, list_append(w.seq, e.target), e.target FROM walk w JOIN good e ON e.task_cluster = w.task_cluster AND e.source = w.last
WHERE e.target <> '__END__' AND NOT list_contains(w.seq, e.target)""",
    "complete": """SELECT w.task_cluster, w.seq FROM walk w JOIN good e ON e.task_cluster = w.task_cluster AND e.source = w.last AND e.target = '__END__'""",
    "sizes": """SELECT task_cluster, count(*) AS n_traces, avg(len(tool_sequence)) AS avg_length FROM clustered GROUP BY 1""",
    "judged": """SELECT p.*, len(p.seq) >= greatest(2, floor(s.avg_length * 0.5)) AS long_enough FROM complete p JOIN sizes s USING (task_cluster)""",
    "covering": """SELECT task_cluster, seq FROM judged j WHERE long_enough OR NOT EXISTS (SELECT 1 FROM judged o WHERE o.task_cluster = j.task_cluster AND o.long_enough)""",
    "frequent": """SELECT 'cluster_' || label AS task_cluster, tool_sequence AS seq FROM common_sequences""",
    "candidates": """SELECT * FROM covering UNION ALL SELECT * FROM frequent WHERE task_cluster NOT IN (SELECT task_cluster FROM covering)""",
    "tried": """SELECT p.task_cluster, p.seq, t.total_duration_ms, t.total_cost_usd, t.total_steps, t.success, t.tool_sequence = p.seq AS same
FROM candidates p JOIN clustered t ON t.task_cluster = p.task_cluster
  AND (t.tool_sequence = p.seq OR (len(p.seq) >= 0.5 * len(t.tool_sequence)
    AND '<' || array_to_string(t.tool_sequence, '><') || '>' LIKE '%<' || array_to_string(p.seq, '>%<') || '>%'))""",
    "used": """SELECT task_cluster, seq, avg(total_duration_ms) AS ms, CAST(sum(total_cost_usd) AS DOUBLE) / count(*) AS usd, avg(total_steps) AS steps,
  avg(CASE WHEN success THEN 1.0 ELSE 0.0 END) AS rate, count(*) AS n
FROM tried t WHERE same OR NOT EXISTS (SELECT 1 FROM tried o WHERE o.task_cluster = t.task_cluster AND o.seq = t.seq AND o.same) GROUP BY ALL""",
    "metrics": """SELECT p.task_cluster, p.seq, round(coalesce(u.ms, 0), 6) AS ms, round(coalesce(u.usd, 0), 9) AS usd, coalesce(u.steps, len(p.seq)) AS steps,
  coalesce(u.rate, 0) AS rate, coalesce(u.n, 0) AS n FROM candidates p LEFT JOIN used u USING (task_cluster, seq)""",
    "supported": f"""SELECT m.* FROM metrics m JOIN sizes s USING (task_cluster) WHERE rate >= {MIN_SUCCESS} AND n >= greatest(2, floor(n_traces * 0.005))""",
    "front": """SELECT * FROM supported a WHERE NOT EXISTS (SELECT 1 FROM supported b WHERE b.task_cluster = a.task_cluster
  AND b.ms <= a.ms AND b.usd <= a.usd AND b.rate >= a.rate AND (b.ms < a.ms OR b.usd < a.usd OR b.rate > a.rate))""",
    "scored": """SELECT *, coalesce((ms - min(ms) OVER w) / nullif(max(ms) OVER w - min(ms) OVER w, 0), 0)
  + coalesce((usd - min(usd) OVER w) / nullif(max(usd) OVER w - min(usd) OVER w, 0), 0)
  + coalesce((max(rate) OVER w - rate) / nullif(max(rate) OVER w - min(rate) OVER w, 0), 0) AS score
FROM front WINDOW w AS (PARTITION BY task_cluster)""",
    "ranked": """SELECT *, row_number() OVER (PARTITION BY task_cluster ORDER BY round(score, 9), seq) - 1 AS pareto_rank FROM scored""",
}
PATH_COLUMNS = """task_cluster, array_to_string(seq, '>') AS tool_sequence, round(ms, 4) AS avg_duration_ms, round(usd, 4) AS avg_cost_usd,
  round(steps, 4) AS avg_steps, round(rate, 4) AS success_rate, n AS execution_count"""

# With many tools the graph has too many paths: those that some run contains are enough,
# because every cluster has a covering one among them.
MANY_TOOLS = {
    **SEARCH,
    "event_logs": CTES["event_logs"].replace("tool_name, props AS", "'tool ' || (k % 31) AS tool_name, props AS", 1),
    "held": """SELECT c.task_cluster, c.workflow_id, c.tool_sequence AS run, [e.target] AS seq, list_position(c.tool_sequence, e.target) AS at_tool
FROM clustered c JOIN good e ON e.task_cluster = c.task_cluster AND e.source = '__START__' AND list_contains(c.tool_sequence, e.target)
UNION ALL
SELECT h.task_cluster, h.workflow_id, h.run, list_append(h.seq, e.target), h.at_tool + list_position(h.run[h.at_tool + 1:], e.target)
FROM held h JOIN good e ON e.task_cluster = h.task_cluster AND e.source = h.seq[-1]
WHERE NOT list_contains(h.seq, e.target) AND list_contains(h.run[h.at_tool + 1:], e.target)""",
    "covering": """SELECT DISTINCT h.task_cluster, h.seq FROM held h JOIN sizes s USING (task_cluster)
JOIN good e ON e.task_cluster = h.task_cluster AND e.source = h.seq[-1] AND e.target = '__END__'
WHERE len(h.seq) >= greatest(2, floor(s.avg_length * 0.5))""",
    "frequent": """SELECT 'none' AS task_cluster, ['none'] AS seq""",
    "tried": """SELECT p.task_cluster, p.seq, t.total_duration_ms, t.total_cost_usd, t.total_steps, t.success, t.tool_sequence = p.seq AS same
FROM covering p JOIN held h ON h.task_cluster = p.task_cluster AND h.seq = p.seq JOIN clustered t ON t.workflow_id = h.workflow_id
WHERE len(p.seq) >= 0.5 * len(t.tool_sequence)""",
}

# ---- anomalies -------------------------------------------------------------------------
FINDINGS = {
    "repeats": """SELECT task_cluster, tool_name, min((workflow_id, n)) AS r FROM (
  SELECT c.task_cluster, e.workflow_id, e.tool_name, count(*) AS n FROM event_logs e JOIN clustered c USING (workflow_id)
  WHERE e.tool_name IS NOT NULL GROUP BY ALL HAVING count(*) >= 2) GROUP BY ALL""",
    "chain": """SELECT e.*, lead(tool_name) OVER w AS next_tool, lead(step_number) OVER w AS next_step FROM event_logs e
WINDOW w AS (PARTITION BY workflow_id ORDER BY step_number, timestamp, event_id)""",
    "retried": """SELECT c.task_cluster, x.tool_name, x.workflow_id, x.step_number, x.next_step FROM chain x JOIN clustered c USING (workflow_id)
WHERE x.status = 'failure' AND x.tool_name = x.next_tool
QUALIFY row_number() OVER (PARTITION BY c.task_cluster, x.tool_name ORDER BY x.workflow_id, x.step_number) = 1""",
    "slow": """SELECT * FROM (SELECT c.task_cluster, e.tool_name, avg(e.duration_ms) AS ms FROM event_logs e JOIN clustered c USING (workflow_id)
    WHERE e.tool_name IS NOT NULL AND c.total_duration_ms > 0 GROUP BY ALL)
  JOIN (SELECT task_cluster, avg(total_duration_ms) AS total FROM clustered WHERE total_duration_ms > 0 GROUP BY 1) USING (task_cluster)
  WHERE ms / total >= 0.24""",
}
REDUNDANT = """SELECT task_cluster, 'redundant_step' AS pattern_type,
  'Tool ''' || tool_name || ''' called ' || r[2] || ' times in workflow ' || r[1] || ' (expected 1)' AS description,
  tool_name, 'medium' AS severity, 'count=' || r[2] || ',workflow_id=' || r[1] AS evidence FROM repeats"""
RETRY = """SELECT task_cluster, 'retry_loop' AS pattern_type, 'Tool ''' || tool_name || ''' retried after failure in workflow ' || workflow_id AS description,
  tool_name, 'high' AS severity, 'failure_step=' || step_number || ',retry_step=' || next_step || ',workflow_id=' || workflow_id AS evidence FROM retried"""
SLOW = """SELECT task_cluster, 'bottleneck' AS pattern_type,
  'Tool ''' || tool_name || ''' avg ' || printf('%.0f', round(ms, 6)) || 'ms (' || printf('%.0f', round(ms / total * 100, 6)) || '% of total ' || printf('%.0f', round(total, 6)) || 'ms)' AS description,
  tool_name, 'high' AS severity,
  'avg_duration_ms=' || round(ms + 1e-9, 1) || ',avg_total_ms=' || round(total + 1e-9, 1) || ',pct_of_total=' || round(ms / total + 1e-9, 3) AS evidence FROM slow"""
# Alignments by dynamic programming over (place in the run, node of the model); 100001 is a
# move of the model alone, 100000 one of the run alone, so ties go to fewer missing moves.
ALIGNED = {
    "runs_in_time": """SELECT c.task_cluster, e.workflow_id, list(e.tool_name ORDER BY e.timestamp, e.step_number, e.event_id) AS seq
FROM event_logs e JOIN clustered c USING (workflow_id) WHERE e.tool_name IS NOT NULL AND c.task_cluster IN (SELECT task_cluster FROM model) GROUP BY ALL""",
    "hops": """SELECT task_cluster, source, target, 0 AS skipped FROM model
UNION
SELECT h.task_cluster, h.source, m.target, h.skipped + 1 FROM hops h JOIN model m ON m.task_cluster = h.task_cluster AND m.source = h.target WHERE h.skipped < 6""",
    "gaps": """SELECT task_cluster, source, target, min(skipped) AS skipped FROM hops GROUP BY ALL""",
    "replay": """SELECT DISTINCT task_cluster, seq, 0 AS at_tool, '__START__' AS node, 0::BIGINT AS v FROM runs_in_time
UNION ALL
SELECT task_cluster, seq, at_tool, o.node, min(o.v) FROM (
  SELECT r.task_cluster, r.seq, r.at_tool + 1 AS at_tool, unnest(CASE WHEN g.skipped IS NULL THEN [{'node': r.node, 'v': r.v + 100000}]
    ELSE [{'node': r.node, 'v': r.v + 100000}, {'node': g.target, 'v': r.v + 100001 * g.skipped}] END) AS o
  FROM replay r LEFT JOIN gaps g ON g.task_cluster = r.task_cluster AND g.source = r.node AND g.target = r.seq[r.at_tool + 1]
  WHERE r.at_tool < len(r.seq)) GROUP BY ALL""",
    "aligned": """SELECT r.task_cluster, r.seq, min(r.v + 100001 * g.skipped) AS v, (any_value(s.skipped) + len(r.seq))::BIGINT AS worst
FROM replay r JOIN gaps g ON g.task_cluster = r.task_cluster AND g.source = r.node AND g.target = '__END__'
JOIN gaps s ON s.task_cluster = r.task_cluster AND s.source = '__START__' AND s.target = '__END__'
WHERE r.at_tool = len(r.seq) GROUP BY r.task_cluster, r.seq""",
}
MODEL = {**MODEL, **ALIGNED}
DEVIATIONS = """SELECT t.task_cluster, t.workflow_id, a.v % 100000 AS missing, a.v // 100000 - a.v % 100000 AS remaining
FROM runs_in_time t JOIN aligned a ON a.task_cluster = t.task_cluster AND a.seq = t.seq WHERE a.v > 0"""
DEVIATION_ROWS = """SELECT task_cluster, 'conformance_deviation' AS pattern_type,
  'Trace deviates from optimal model: ' || missing || ' missing moves, ' || remaining || ' left-over moves' AS description,
  CAST(NULL AS VARCHAR) AS tool_name, 'medium' AS severity, 'missing=' || missing || ',remaining=' || remaining || ',workflow_id=' || workflow_id AS evidence FROM deviations"""

# ---- failure warnings: optimal path = most frequent sequence of the cluster --------------
WARN = {
    "best": "SELECT 'cluster_' || label AS task_cluster, tool_sequence FROM common_sequences",
    "classes": """SELECT task_cluster, count(*) FILTER (WHERE success) AS ns, count(*) FILTER (WHERE NOT success) AS nf FROM clustered GROUP BY 1
HAVING count(*) FILTER (WHERE success) > 0 AND count(*) FILTER (WHERE NOT success) > 0""",
    "steps": "SELECT task_cluster, unnest(tool_sequence) AS tool, generate_subscripts(tool_sequence, 1) - 1 AS pos FROM best",
    "presence": """SELECT s.task_cluster, s.tool, s.pos, c.ns, c.nf,
  (SELECT count(*) FROM clustered t WHERE t.task_cluster = s.task_cluster AND t.success AND list_contains(t.tool_sequence, s.tool)) AS shas,
  (SELECT count(*) FROM clustered t WHERE t.task_cluster = s.task_cluster AND NOT t.success AND NOT list_contains(t.tool_sequence, s.tool)) AS fmiss
FROM steps s JOIN classes c USING (task_cluster)""",
    "missing_steps": """SELECT task_cluster, 0 AS kind, pos, '' AS param, tool || ' was missing in ' || fmiss || '/' || nf || ' failed runs but present in ' || shas || '/' || ns || ' successful runs' AS warning
FROM presence WHERE shas / ns > {in_success} AND fmiss / nf > {missing} AND fmiss >= 2""",
    "params": """SELECT c.task_cluster, e.tool_name AS tool, c.success, 'k' AS param, json_extract_string(e.tool_parameters, '$.k') AS value, count(*) AS n
FROM event_logs e JOIN clustered c USING (workflow_id) WHERE e.tool_name IS NOT NULL GROUP BY ALL""",
    "tops": """SELECT *, sum(n) OVER (PARTITION BY task_cluster, tool, success, param) AS total FROM params
QUALIFY row_number() OVER (PARTITION BY task_cluster, tool, success, param ORDER BY n DESC, value) = 1""",
    "diverging": """SELECT s.task_cluster, 1 AS kind, s.pos, g.param, 'at ' || s.tool || ', successful runs used ' || g.param || '=' || g.value || ' (' || g.n || '/' || CAST(g.total AS BIGINT)
  || ' runs) while failed runs used ' || b.param || '=' || b.value AS warning
FROM steps s JOIN tops g ON g.task_cluster = s.task_cluster AND g.tool = s.tool AND g.success
JOIN tops b ON b.task_cluster = s.task_cluster AND b.tool = s.tool AND NOT b.success AND b.param = g.param
WHERE g.value <> b.value""",
}
MISSING = WARN.pop("missing_steps")


def warn(in_success: float, missing: float) -> dict[str, str]:
    return {**WARN, "missing_steps": MISSING.format(in_success=in_success, missing=missing)}


# ---- decision tree ------------------------------------------------------------------------
def tree(members: str) -> dict[str, str]:
    return {
        "planted": members,
        "rep_counts": "SELECT task_cluster, subcluster, tool_sequence, count(*) AS n FROM planted GROUP BY ALL",
        "reps": """SELECT r.task_cluster, r.subcluster, r.tool_sequence AS seq, s.n, s.rate FROM (
  SELECT *, row_number() OVER (PARTITION BY task_cluster, subcluster ORDER BY n DESC, tool_sequence) AS rn FROM rep_counts) r
JOIN (SELECT task_cluster, subcluster, count(*) AS n, avg(CASE WHEN success THEN 1.0 ELSE 0.0 END) AS rate FROM planted GROUP BY ALL) s USING (task_cluster, subcluster) WHERE rn = 1""",
        "spread": "SELECT task_cluster, subcluster, unnest(seq) AS tool, generate_subscripts(seq, 1) AS pos FROM reps",
        "agreed": """SELECT s.task_cluster, s.pos, count(*) = any_value(c.subs) AND count(DISTINCT s.tool) = 1 AS same FROM spread s
JOIN (SELECT task_cluster, count(*) AS subs FROM reps GROUP BY 1) c USING (task_cluster) GROUP BY s.task_cluster, s.pos""",
        "splits": """SELECT r.task_cluster, p.len AS plen, min(r.seq)[1:p.len] AS prefix, min(r.seq)[p.len] AS branch_tool FROM reps r
JOIN (SELECT a.task_cluster, count(*) AS len FROM agreed a WHERE NOT EXISTS (SELECT 1 FROM agreed b WHERE b.task_cluster = a.task_cluster AND b.pos <= a.pos AND NOT b.same) GROUP BY 1) p USING (task_cluster)
GROUP BY r.task_cluster, p.len HAVING count(*) >= 2""",
        "answers": """SELECT p.task_cluster, p.subcluster, p.workflow_id, e.tool_response FROM planted p JOIN splits s USING (task_cluster)
JOIN event_logs e ON e.workflow_id = p.workflow_id AND e.activity = 'tool_call:' || s.branch_tool
QUALIFY row_number() OVER (PARTITION BY p.task_cluster, p.subcluster, p.workflow_id ORDER BY e.step_number, e.timestamp, e.event_id) = 1""",
        "fields": """SELECT task_cluster, subcluster, 'band' AS field, json_extract_string(tool_response, '$.band') AS value, count(*) AS n FROM answers GROUP BY ALL
UNION ALL SELECT task_cluster, subcluster, 'ok', json_extract_string(tool_response, '$.ok'), count(*) FROM answers GROUP BY ALL""",
        "profiles": """SELECT task_cluster, subcluster, field, list(value) AS uniques, sum(n) AS total, max(n) AS top_n,
  arg_min(value, (-n, value)) AS top_value FROM fields GROUP BY ALL""",
        "pairs": """SELECT a.task_cluster, a.subcluster AS l, b.subcluster AS r, a.field, round((a.top_n / a.total + b.top_n / b.total) / 2, 9) AS separation
FROM profiles a JOIN profiles b ON a.task_cluster = b.task_cluster AND a.field = b.field AND a.subcluster < b.subcluster
WHERE NOT list_has_any(a.uniques, b.uniques) AND len(a.uniques) + len(b.uniques) <= 5 AND (len(a.uniques) + len(b.uniques)) / (a.total + b.total) <= 0.5""",
        "votes": """SELECT task_cluster, field FROM pairs QUALIFY row_number() OVER (PARTITION BY task_cluster, l, r ORDER BY separation DESC, field) = 1""",
        "conditions": """SELECT task_cluster, arg_min(field, (-n, field)) AS condition_key FROM (SELECT task_cluster, field, count(*) AS n FROM votes GROUP BY ALL) GROUP BY 1""",
        "suffixes": """SELECT r.*, s.prefix, s.branch_tool, s.plen, list_filter(list_transform(range(s.plen + 1, len(r.seq) + 1),
  lambda i: CASE WHEN i = s.plen + 1 OR r.seq[i] <> r.seq[i - 1] THEN r.seq[i] END), lambda x: x IS NOT NULL) AS path FROM reps r JOIN splits s USING (task_cluster)""",
        "tail": "SELECT task_cluster, subcluster, unnest(path) AS tool, generate_subscripts(path, 1) AS pos FROM suffixes",
        "own": """SELECT t.task_cluster, t.subcluster, arg_max(t.tool, t.pos) AS tool FROM tail t
WHERE NOT EXISTS (SELECT 1 FROM tail o WHERE o.task_cluster = t.task_cluster AND o.tool = t.tool AND o.subcluster <> t.subcluster) GROUP BY ALL""",
    }


TREE_ROWS = """
SELECT s.task_cluster, s.subcluster, array_to_string(s.prefix, '>') AS prefix, s.branch_tool, c.condition_key, array_to_string(s.path, '>') AS path,
  s.n AS execution_count, round(s.rate, 4) AS success_rate, p.top_value AS condition_value,
  CASE WHEN len(s.path) = 0 THEN 'Direct completion' ELSE upper(coalesce(o.tool, s.path[-1])[1:1]) || substring(replace(coalesce(o.tool, s.path[-1]), '_', ' '), 2) END AS label
FROM suffixes s LEFT JOIN conditions c USING (task_cluster)
LEFT JOIN profiles p ON p.task_cluster = s.task_cluster AND p.subcluster = s.subcluster AND p.field = c.condition_key
LEFT JOIN own o ON o.task_cluster = s.task_cluster AND o.subcluster = s.subcluster
WHERE s.rate > 0 OR s.n >= 5"""
BY_BAND = """SELECT 'starts ' || t.tool_sequence[1] AS task_cluster, 'band ' || (c.k // 25) AS subcluster, t.workflow_id, t.tool_sequence, t.success
FROM traces t JOIN calls c USING (workflow_id) QUALIFY row_number() OVER (PARTITION BY t.workflow_id ORDER BY c.ts, c.source_id) = 1"""
BY_SECOND = """SELECT 'starts ' || tool_sequence[1] AS task_cluster, coalesce('then ' || tool_sequence[2], 'ends') AS subcluster, workflow_id, tool_sequence, success
FROM traces WHERE len(tool_sequence) > 0"""

# ---- suggestions ----------------------------------------------------------------------------
SUGGEST = {
    **FINDINGS, **MODEL,
    "best": "SELECT 'cluster_' || label AS task_cluster, tool_sequence, avg_duration_ms FROM common_sequences JOIN (SELECT label, avg(total_duration_ms) AS avg_duration_ms FROM labelled GROUP BY 1) USING (label)",
    "reordered": """SELECT t.task_cluster, t.workflow_id, t.tool_sequence, t.total_duration_ms, b.tool_sequence AS best, b.avg_duration_ms
FROM clustered t JOIN best b USING (task_cluster)
WHERE t.tool_sequence <> b.tool_sequence AND list_sort(list_distinct(t.tool_sequence)) = list_sort(list_distinct(b.tool_sequence))
QUALIFY row_number() OVER (PARTITION BY t.task_cluster ORDER BY t.workflow_id) = 1""",
    "extra": """SELECT * FROM (SELECT c.task_cluster, e.tool_name, e.workflow_id, avg(e.duration_ms) AS ms FROM event_logs e JOIN clustered c USING (workflow_id) JOIN best b USING (task_cluster)
WHERE e.tool_name IS NOT NULL AND NOT list_contains(b.tool_sequence, e.tool_name)
  AND NOT EXISTS (SELECT 1 FROM repeats r WHERE r.task_cluster = c.task_cluster AND r.tool_name = e.tool_name)
GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY task_cluster, tool_name ORDER BY workflow_id) = 1""",
    "extra_all": """SELECT * FROM (SELECT c.task_cluster, e.tool_name, e.workflow_id, avg(e.duration_ms) AS ms FROM event_logs e JOIN clustered c USING (workflow_id) JOIN best b USING (task_cluster)
WHERE e.tool_name IS NOT NULL AND NOT list_contains(b.tool_sequence, e.tool_name)
GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY task_cluster, tool_name ORDER BY workflow_id) = 1""",
}
SKIP_ROWS = """SELECT task_cluster, 'skip_step' AS suggestion_type, 'Tool ''' || tool_name || ''' not in optimal path — consider removing' AS message, 'medium' AS priority,
  tool_name AS affected_tools, round(ms, 4) AS estimated_saving_ms FROM {}"""
REORDER_ROWS = """SELECT task_cluster, 'reorder' AS suggestion_type, 'Reorder tools in workflow ' || workflow_id || ': current [' || array_to_string(tool_sequence, ' → ')
  || '] → optimal [' || array_to_string(best, ' → ') || ']' AS message, 'medium' AS priority,
  array_to_string(list_sort(list_distinct(tool_sequence)), '>') AS affected_tools, round(greatest(0, total_duration_ms - avg_duration_ms), 4) AS estimated_saving_ms FROM reordered"""


def pattern_rows(source: str, kind: str, priority: str, saving: str) -> str:
    return f"SELECT task_cluster, '{kind}' AS suggestion_type, description AS message, '{priority}' AS priority, coalesce(tool_name, '') AS affected_tools, {saving} AS estimated_saving_ms FROM ({source})"


ORACLES: dict[str, str] = {
    "traces": query("""
SELECT workflow_id, array_to_string(tool_sequence, '>') AS tool_sequence, round(total_duration_ms, 4) AS total_duration_ms,
  round(CAST(total_cost_usd AS DOUBLE), 4) AS total_cost_usd, total_steps, success FROM traces"""),
    "directly_follows_graph": query("""
SELECT task_cluster, source, target, frequency, round(success_rate, 4) AS success_rate, round(avg_duration_ms, 4) AS avg_duration_ms,
  round(avg_cost_usd, 4) AS avg_cost_usd FROM edges"""),
    "graph_totals": query("""
SELECT task_cluster, count(*) AS total_traces, (SELECT count(DISTINCT n) FROM (SELECT e.task_cluster AS c, unnest([source, target]) AS n FROM edges e) x WHERE x.c = t.task_cluster) AS nodes
FROM clustered t GROUP BY task_cluster"""),
    "process_model": query("SELECT task_cluster, source, target, frequency FROM model", **MODEL),
    "conformance_deviations": query(DEVIATION_ROWS, **MODEL, deviations=DEVIATIONS),
    "redundant_steps": query(REDUNDANT, **FINDINGS),
    "retry_loops": query(RETRY, **FINDINGS),
    "bottleneck_tools": query(SLOW, **FINDINGS),
    "detect_patterns": query(f"{REDUNDANT} UNION ALL {RETRY} UNION ALL {SLOW} UNION ALL {DEVIATION_ROWS}", **FINDINGS, **MODEL, deviations=DEVIATIONS),
    "loop_steps": query("""
SELECT workflow_id, CAST(step_number AS BIGINT) AS step_number, tool_name, array_to_string(recent, '>') AS recent FROM (
  SELECT *, list(tool_name) OVER (PARTITION BY workflow_id ORDER BY step_number, timestamp, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS recent
  FROM event_logs WHERE tool_name IS NOT NULL)
WHERE list_max(list_transform(recent, lambda x: len(list_filter(recent, lambda y: y = x)))) >= 4"""),
    "enumerate_paths": query("SELECT task_cluster, array_to_string(seq, '>') AS tool_sequence FROM complete", **SEARCH),
    "reliable_edges": query(f"SELECT task_cluster, source, target, frequency FROM edges WHERE success_rate >= 0.7"),
    "covering_paths": query("SELECT task_cluster, array_to_string(seq, '>') AS tool_sequence FROM covering", **SEARCH),
    "most_frequent_sequences": query("SELECT task_cluster, array_to_string(seq, '>') AS tool_sequence FROM frequent", **SEARCH),
    "path_metrics": query(f"SELECT {PATH_COLUMNS} FROM metrics", **SEARCH),
    "supported_paths": query(f"SELECT {PATH_COLUMNS} FROM supported", **SEARCH),
    "pareto_front": query(f"SELECT {PATH_COLUMNS} FROM front", **SEARCH),
    "find_pareto_paths": query(f"SELECT {PATH_COLUMNS}, round(score, 4) AS score, pareto_rank FROM ranked", **SEARCH),
    "find_pareto_paths_many_tools": query(
        f"SELECT {PATH_COLUMNS}, round(score, 4) AS score, pareto_rank FROM ranked", **MANY_TOOLS),
    "knee_points": query(f"SELECT {PATH_COLUMNS}, round(score, 4) AS score, pareto_rank FROM ranked WHERE pareto_rank = 0", **SEARCH),
    "missing_step_warnings": query("SELECT task_cluster, CAST(kind AS BIGINT) AS kind, pos, param, warning FROM missing_steps", **warn(0.2, 0.2)),
    "parameter_warnings": query("SELECT task_cluster, CAST(kind AS BIGINT) AS kind, pos, param, warning FROM diverging", **warn(0.2, 0.2)),
    "failure_warnings": query("""
SELECT task_cluster, array_to_string(list_transform(list_sort(list((kind, pos, param, warning)))[1:3], lambda w: w[4]), '>') AS failure_warnings
FROM (SELECT * FROM missing_steps UNION ALL SELECT * FROM diverging) GROUP BY 1""", **warn(0.7, 0.4)),
    "discriminating_fields": query("""
SELECT task_cluster, l AS left_sub, r AS right_sub, field FROM pairs QUALIFY row_number() OVER (PARTITION BY task_cluster, l, r ORDER BY separation DESC, field) = 1""", **tree(BY_BAND)),
    "decision_tree_by_band": query(TREE_ROWS, **tree(BY_BAND)),
    "decision_tree_by_second_tool": query(TREE_ROWS, **tree(BY_SECOND)),
    "pattern_suggestions": query(
        pattern_rows(REDUNDANT, "skip_step", "high", "0.0") + " UNION ALL " + pattern_rows(RETRY, "fix_reliability", "high", "0.0")
        + " UNION ALL " + pattern_rows(SLOW.replace("SELECT task_cluster,", "SELECT ms, task_cluster,", 1), "optimize_step", "medium", "round(ms + 1e-9, 1)")
        + " UNION ALL " + pattern_rows(DEVIATION_ROWS, "remove_step", "medium", "0.0"), **SUGGEST, deviations=DEVIATIONS),
    "reorder_suggestions": query(REORDER_ROWS, **SUGGEST),
    "skip_suggestions": query(SKIP_ROWS.format("extra_all"), **SUGGEST),
    "generate_suggestions": query(
        pattern_rows(REDUNDANT, "skip_step", "high", "0.0") + " UNION ALL " + pattern_rows(RETRY, "fix_reliability", "high", "0.0")
        + " UNION ALL " + pattern_rows(SLOW.replace("SELECT task_cluster,", "SELECT ms, task_cluster,", 1), "optimize_step", "medium", "round(ms + 1e-9, 1)")
        + " UNION ALL " + REORDER_ROWS + " UNION ALL " + SKIP_ROWS.format("extra"), **SUGGEST),
    "mode_significance": query("""
SELECT CAST(n1 AS BIGINT) AS n_guided, CAST(n2 AS BIGINT) AS n_exploration, round(u, 4) AS mann_whitney_u,
  round((u - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))), 4) AS z,
  round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) * (1 - 3 / (4 * (n1 + n2) - 9)), 4) AS hedges_g
FROM (SELECT sum(midrank) FILTER (WHERE is_guided = 1) - count(*) FILTER (WHERE is_guided = 1) * (count(*) FILTER (WHERE is_guided = 1) + 1) / 2 AS u,
    CAST(count(*) FILTER (WHERE is_guided = 1) AS DOUBLE) AS n1, CAST(count(*) FILTER (WHERE is_guided = 0) AS DOUBLE) AS n2,
    sum(t * t - 1.0) AS ties,
    avg(duration_ms) FILTER (WHERE is_guided = 1) AS m1, avg(duration_ms) FILTER (WHERE is_guided = 0) AS m2,
    var_samp(duration_ms) FILTER (WHERE is_guided = 1) AS v1, var_samp(duration_ms) FILTER (WHERE is_guided = 0) AS v2
  FROM (SELECT *, count(*) OVER (PARTITION BY duration_ms) AS t,
      rank() OVER (ORDER BY duration_ms) + (count(*) OVER (PARTITION BY duration_ms) - 1) / 2 AS midrank FROM terminal))"""),
}

# ---- the whole run, results of whole clusters -------------------------------------------------
# The vectors of one label point the same way and those of different labels do not, so a
# cluster is the set of workflows with one label, at least five of them.
GROUPS = {
    "vector_groups": """SELECT label, 'cluster_' || (row_number() OVER (ORDER BY count(*) DESC, min(workflow_id)) - 1) AS task_cluster
FROM members GROUP BY label HAVING count(*) >= 5""",
    "grouped_runs": """SELECT g.task_cluster, t.* FROM traces t JOIN members USING (workflow_id) JOIN vector_groups g USING (label)""",
    "clustered": """SELECT * FROM grouped_runs WHERE task_cluster IN (SELECT task_cluster FROM grouped_runs WHERE success)""",
}
SUCCESSES = {**GROUPS, "clustered": "SELECT * FROM grouped_runs WHERE success"}
FULL_MODEL = {**MODEL, "model": MODEL["model"].replace("HAVING count(*) >= 10", "")}
DEFAULT_FINDINGS = {**FINDINGS, "slow": FINDINGS["slow"].replace("0.24", "0.40")}
DEFAULT_SEARCH = {
    **SEARCH,
    "good": "SELECT * FROM edges WHERE success_rate >= 0.85",
    "frequent": """SELECT task_cluster, seq FROM (SELECT task_cluster, tool_sequence AS seq, count(*) AS n FROM clustered WHERE len(tool_sequence) > 0 GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY task_cluster ORDER BY n DESC, seq) = 1""",
    "supported": "SELECT m.* FROM metrics m JOIN sizes s USING (task_cluster) WHERE rate >= 0.85 AND n >= greatest(2, floor(n_traces * 0.10))",
}
ORACLES["run_analysis_group_graph"] = query("""
SELECT task_cluster, source, target, frequency, round(success_rate, 4) AS success_rate, round(avg_duration_ms, 4) AS avg_duration_ms,
  round(avg_cost_usd, 4) AS avg_cost_usd FROM edges""", **SUCCESSES)
QUALITY = """
SELECT f.task_cluster, round(f.fitness, 4) AS fitness, round(p.precision, 4) AS precision
FROM (SELECT t.task_cluster, avg(1 - (a.v // 100000) / a.worst) AS fitness FROM runs_in_time t JOIN aligned a ON a.task_cluster = t.task_cluster AND a.seq = t.seq GROUP BY 1) f
JOIN (SELECT o.task_cluster, sum(o.visits * o.used) / sum(o.visits * a.options) AS precision
  FROM (SELECT task_cluster, source, count(*) AS visits, count(DISTINCT target) FILTER (WHERE allowed) AS used FROM checked GROUP BY ALL) o
  JOIN (SELECT task_cluster, source, count(*) AS options FROM model GROUP BY ALL) a USING (task_cluster, source) GROUP BY 1) p USING (task_cluster)"""
ORACLES["model_quality"] = query(QUALITY, **MODEL)
ORACLES["run_alignments"] = query("""
SELECT a.task_cluster, array_to_string(a.seq, '>') AS tool_sequence, count(*) AS n, a.v // 100000 AS cost, a.v % 100000 AS missing, any_value(a.worst) AS worst
FROM aligned a JOIN runs_in_time t ON t.task_cluster = a.task_cluster AND t.seq = a.seq GROUP BY a.task_cluster, a.seq, a.v""",
    **{**FULL_MODEL, "whole": FULL_MODEL["model"],
       "model": "SELECT * FROM whole QUALIFY 6 * frequency >= sum(frequency) OVER (PARTITION BY task_cluster, source)"})
ORACLES["run_analysis_group_quality"] = query(QUALITY, **GROUPS, **FULL_MODEL)
ORACLES["run_analysis_group_patterns"] = query(
    f"{REDUNDANT} UNION ALL {RETRY} UNION ALL {SLOW} UNION ALL {DEVIATION_ROWS}",
    **GROUPS, **DEFAULT_FINDINGS, **FULL_MODEL, deviations=DEVIATIONS)
ORACLES["run_analysis_group_pareto"] = query(
    f"SELECT {PATH_COLUMNS}, round(score, 4) AS score, pareto_rank FROM ranked", **SUCCESSES, **DEFAULT_SEARCH)


# ---- sub-clusters: closest pairs merge round by round until the closest are too far --------------
def subclusters(source: str, cut: float = 0.55) -> dict[str, str]:
    """(task_cluster, workflow_id, subcluster) of the runs in ``source``.

    ``rounds`` holds per round the clusters of the shapes (``pair`` false) and the weighted
    sums of distances between clusters; pairs that are each other's nearest merge.
    """
    return {
        "shapes": f"""SELECT task_cluster AS part, array_to_string(tool_sequence, chr(1)) AS item, CAST(count(*) AS DOUBLE) AS weight,
  any_value(array_to_string(list_transform(tool_sequence, lambda t: t[1:1]), '')) AS coded FROM {source} GROUP BY ALL""",
        "rounds": f"""SELECT 0 AS round, false AS pair, part, item AS a, item AS b, 0.0::DOUBLE AS s, weight AS na, weight AS nb FROM shapes
UNION ALL
SELECT 0, true, x.part, x.item, y.item, x.weight * y.weight
  * coalesce(2.0 * levenshtein(x.coded, y.coded) / nullif(length(x.coded) + length(y.coded), 0), 0), x.weight, y.weight
FROM shapes x JOIN shapes y ON x.part = y.part AND x.item <> y.item
UNION ALL
(WITH near AS (
  SELECT part, a, first(b ORDER BY round(s / (na * nb), 12), b) AS b, any_value(na) AS na FROM rounds
  WHERE pair AND round(s / (na * nb), 12) <= {cut} GROUP BY part, a),
meet AS (SELECT x.part, x.a AS keep, x.b AS gone, x.na + y.na AS size FROM near x
  JOIN near y ON x.part = y.part AND x.b = y.a AND y.b = x.a WHERE x.a < x.b),
place AS (SELECT part, keep AS old, keep AS new, size FROM meet UNION ALL SELECT part, gone, keep, size FROM meet)
SELECT any_value(r.round) + 1, r.pair, r.part, CASE WHEN r.pair THEN coalesce(p.new, r.a) ELSE r.a END AS a2,
  coalesce(q.new, r.b) AS b2, sum(r.s), any_value(coalesce(p.size, r.na)), any_value(coalesce(q.size, r.nb))
FROM rounds r LEFT JOIN place p ON p.part = r.part AND p.old = r.a LEFT JOIN place q ON q.part = r.part AND q.old = r.b
WHERE EXISTS (SELECT 1 FROM meet) AND (NOT r.pair OR coalesce(p.new, r.a) <> coalesce(q.new, r.b))
GROUP BY r.pair, r.part, a2, b2)""",
        "subclustered": f"""SELECT part AS task_cluster, workflow_id,
  'subcluster_' || (dense_rank() OVER (PARTITION BY part ORDER BY size DESC, cluster) - 1) AS subcluster
FROM (SELECT m.part, m.b AS cluster, c.workflow_id, count(*) OVER (PARTITION BY m.part, m.b) AS size
  FROM (SELECT * FROM rounds WHERE NOT pair AND round = (SELECT max(round) FROM rounds)) m
  JOIN {source} c ON c.task_cluster = m.part AND array_to_string(c.tool_sequence, chr(1)) = m.a)""",
    }


ORACLES["subcluster_by_trace"] = query("SELECT * FROM subclustered", **subclusters("clustered"))

# ---- the whole run, clusters and sub-clusters ------------------------------------------------------
LEVELS = {
    **GROUPS, **subclusters("grouped_runs"),
    "leveled": """SELECT * FROM grouped_runs UNION ALL
SELECT s.task_cluster || '/' || s.subcluster, r.* EXCLUDE (task_cluster) FROM grouped_runs r JOIN subclustered s USING (workflow_id)""",
    "clustered": "SELECT * FROM leveled WHERE task_cluster IN (SELECT task_cluster FROM leveled WHERE success)",
}
LEVEL_SUCCESSES = {**LEVELS, "clustered": "SELECT * FROM leveled WHERE success"}
# The path search sees successful runs only, the rest of the run sees all of them.
LEVEL_BEST = {
    **LEVELS,
    **{name: re.sub(r"\bclustered\b", "succeeded", text) for name, text in {**DEFAULT_SEARCH, "edges": CTES["edges"]}.items()},
    "succeeded": "SELECT * FROM leveled WHERE success",
    "best": "SELECT task_cluster, seq AS tool_sequence, ms AS avg_duration_ms FROM ranked WHERE pareto_rank = 0",
}
DEFAULT_WARN = {
    **warn(0.7, 0.4),
    "diverging": WARN["diverging"] + " AND g.n / g.total > 0.6 AND b.n / b.total > 0.4",
}
del DEFAULT_WARN["best"]
DEFAULT_SUGGEST = {k: v for k, v in SUGGEST.items() if k in ("reordered", "extra")}
WARNING_LIST = """SELECT task_cluster, array_to_string(list_transform(list_sort(list((kind, pos, param, warning)))[1:3], lambda w: w[4]), '>') AS failure_warnings
FROM (SELECT * FROM missing_steps UNION ALL SELECT * FROM diverging) GROUP BY 1"""


def by_key(body: str) -> str:
    return f"SELECT * RENAME (task_cluster AS task_key) FROM ({body})"


ORACLES["run_analysis_graph"] = query(by_key("""SELECT task_cluster, source, target, frequency, round(success_rate, 4) AS success_rate,
  round(avg_duration_ms, 4) AS avg_duration_ms, round(avg_cost_usd, 4) AS avg_cost_usd FROM edges"""), **LEVEL_SUCCESSES)
ORACLES["run_analysis_quality"] = query(by_key(QUALITY), **LEVELS, **FULL_MODEL)
ORACLES["run_analysis_patterns"] = query(
    by_key(f"{REDUNDANT} UNION ALL {RETRY} UNION ALL {SLOW} UNION ALL {DEVIATION_ROWS}"),
    **LEVELS, **DEFAULT_FINDINGS, **FULL_MODEL, deviations=DEVIATIONS)
ORACLES["run_analysis_pareto"] = query(
    by_key(f"SELECT {PATH_COLUMNS}, round(score, 4) AS score, pareto_rank FROM ranked"), **LEVEL_SUCCESSES, **DEFAULT_SEARCH)
ORACLES["run_analysis_warnings"] = query(by_key(WARNING_LIST), **LEVEL_BEST, **DEFAULT_WARN)
ORACLES["run_analysis_suggestions"] = query(
    by_key(
        pattern_rows(REDUNDANT, "skip_step", "high", "0.0") + " UNION ALL " + pattern_rows(RETRY, "fix_reliability", "high", "0.0")
        + " UNION ALL " + pattern_rows(SLOW.replace("SELECT task_cluster,", "SELECT ms, task_cluster,", 1), "optimize_step", "medium", "round(ms + 1e-9, 1)")
        + " UNION ALL " + pattern_rows(DEVIATION_ROWS, "remove_step", "medium", "0.0")
        + " UNION ALL " + REORDER_ROWS + " UNION ALL " + SKIP_ROWS.format("extra")),
    **LEVEL_BEST, **DEFAULT_FINDINGS, **FULL_MODEL, **DEFAULT_SUGGEST, deviations=DEVIATIONS)

# New paths: the path of a cluster's largest sub-cluster leads, the others are its alternatives.
PATH_ROWS = {
    **LEVEL_BEST, **DEFAULT_WARN,
    "clustered": "SELECT * FROM grouped_runs",
    "sub_sizes": "SELECT task_cluster, subcluster, count(*) AS runs FROM subclustered GROUP BY ALL",
    "listed": """SELECT z.task_cluster, z.subcluster, z.runs, b.seq, b.ms, b.steps, b.rate,
  row_number() OVER (PARTITION BY z.task_cluster ORDER BY z.runs DESC, z.subcluster) - 1 AS place
FROM sub_sizes z JOIN ranked b ON b.task_cluster = z.task_cluster || '/' || z.subcluster WHERE b.pareto_rank = 0""",
    "best": "SELECT task_cluster, seq AS tool_sequence FROM listed WHERE place = 0",
    "named": """SELECT g.task_cluster, substring(arg_min(m.task_description, (length(m.task_description), m.task_description)), 1, 60) AS name
FROM members m JOIN vector_groups g USING (label) GROUP BY 1""",
    "winners": "SELECT name, max(task_cluster) AS task_cluster FROM named JOIN best USING (task_cluster) GROUP BY name",
    "warned": WARNING_LIST,
    "rates": """SELECT task_cluster, count(*) AS execution_count,
  avg(CASE WHEN completed THEN 1.0 ELSE 0.0 END) FILTER (WHERE is_guided AND n_terminal > 0) AS guided,
  avg(CASE WHEN completed THEN 1.0 ELSE 0.0 END) FILTER (WHERE NOT is_guided AND n_terminal > 0) AS exploration
FROM grouped_runs GROUP BY 1""",
    **tree("SELECT s.task_cluster, s.subcluster, s.workflow_id, r.tool_sequence, r.success FROM subclustered s JOIN grouped_runs r USING (workflow_id)"),
    "branched": "SELECT task_cluster, any_value(branch_tool) AS branch_tool FROM suffixes WHERE rate > 0 OR n >= 5 GROUP BY 1",
}
NEW_PATHS = """
SELECT w.name AS task_cluster, array_to_string(l.seq, '>') AS tool_sequence, round(l.ms, 4) AS avg_duration_ms, round(l.steps, 4) AS avg_steps,
  round(l.rate, 4) AS success_rate, r.execution_count, round(r.guided, 4) AS guided_success_rate, round(r.exploration, 4) AS exploration_success_rate,
  coalesce(f.failure_warnings, '') AS failure_warnings,
  (SELECT count(*) FROM listed o WHERE o.task_cluster = l.task_cluster AND o.place > 0) AS alternatives, b.branch_tool
FROM winners w JOIN listed l ON l.task_cluster = w.task_cluster AND l.place = 0 JOIN rates r ON r.task_cluster = w.task_cluster
LEFT JOIN warned f ON f.task_cluster = w.task_cluster LEFT JOIN branched b ON b.task_cluster = w.task_cluster"""
ORACLES["run_analysis"] = query(NEW_PATHS, **PATH_ROWS)
ORACLES["run_analysis_stored"] = query("""
SELECT task_cluster, array_to_string(tool_sequence, '>') AS tool_sequence, execution_count, CAST(2 AS BIGINT) AS version FROM optimal_paths
WHERE task_cluster NOT IN (SELECT task_cluster FROM fresh)
UNION ALL SELECT task_cluster, tool_sequence, execution_count, 2 FROM fresh""", **PATH_ROWS, fresh=NEW_PATHS)
ORACLES["run_analysis_alternatives"] = query("""
SELECT w.name AS task_cluster, l.place - 1 AS pos, array_to_string(l.seq, '>') AS tool_sequence, l.runs AS execution_count,
  round(l.rate, 4) AS success_rate, round(l.steps, 4) AS avg_steps FROM winners w JOIN listed l USING (task_cluster) WHERE l.place > 0""", **PATH_ROWS)
ORACLES["run_analysis_centroids"] = query("""
SELECT w.name AS task_cluster, v.pos - 1 AS pos, round(avg(CAST(v.x AS DOUBLE)), 4) AS x
FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM members) v
JOIN vector_groups g USING (label) JOIN winners w USING (task_cluster) GROUP BY w.name, v.pos""", **PATH_ROWS)

# The tree as one row per branch, in the order the tree lists them.
TREE_STRUCTS = f"""
SELECT t.task_cluster, t.branch_tool, t.condition_key, t.path, t.execution_count, t.success_rate, t.condition_value, t.label,
  row_number() OVER (PARTITION BY t.task_cluster ORDER BY t.execution_count DESC, t.subcluster) - 1 AS pos,
  array_to_string(list_filter(list_transform(range(1, len(p.prefix) + 1), lambda i: CASE WHEN i = 1 OR p.prefix[i] <> p.prefix[i - 1] THEN p.prefix[i] END),
    lambda x: x IS NOT NULL), '>') AS common_prefix,
  'Based on ' || upper(t.branch_tool[1:1]) || substring(replace(t.branch_tool, '_', ' '), 2) || ' result?' AS condition_question
FROM ({TREE_ROWS}) t JOIN splits p ON p.task_cluster = t.task_cluster"""
ORACLES["decision_trees_by_band"] = query(TREE_STRUCTS, **tree(BY_BAND))
ORACLES["decision_trees_by_second_tool"] = query(TREE_STRUCTS, **tree(BY_SECOND))
