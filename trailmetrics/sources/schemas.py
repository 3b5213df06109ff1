"""Schemas of the three core tables, as Spark DDL."""

EVENT_LOG_DDL = """
event_id STRING, workflow_id STRING, timestamp TIMESTAMP_NTZ, activity STRING,
agent_name STRING, agent_role STRING, tool_name STRING,
tool_parameters STRING, tool_response STRING,
llm_model STRING, llm_prompt_tokens INT, llm_completion_tokens INT,
llm_reasoning STRING, llm_prompt STRING,
duration_ms DOUBLE, cost_usd DECIMAL(10,6),
status STRING, error_message STRING, step_number INT, parent_event_id STRING
"""

EMBEDDING_DDL = """
workflow_id STRING, task_description STRING, embedding ARRAY<FLOAT>,
model_version STRING, created_at TIMESTAMP_NTZ
"""

OPTIMAL_PATH_DDL = """
path_id STRING, task_cluster STRING, tool_sequence ARRAY<STRING>,
avg_duration_ms DOUBLE, avg_steps DOUBLE, success_rate DOUBLE, execution_count BIGINT,
embedding ARRAY<DOUBLE>, guided_success_rate DOUBLE, exploration_success_rate DOUBLE,
failure_warnings ARRAY<STRING>,
alternative_paths ARRAY<STRUCT<tool_sequence: ARRAY<STRING>, execution_count: BIGINT,
                               success_rate: DOUBLE, avg_steps: DOUBLE>>,
decision_tree STRUCT<common_prefix: ARRAY<STRING>, branch_tool: STRING,
                     condition_question: STRING, condition_key: STRING,
                     branches: ARRAY<STRUCT<path: ARRAY<STRING>, execution_count: BIGINT,
                                            success_rate: DOUBLE, condition_value: STRING,
                                            label: STRING>>>,
updated_at TIMESTAMP_NTZ
"""

# The accepted event statuses and the activity names with a meaning.
STATUSES = ("success", "failure", "timeout", "loop_detected")
START = "workflow:start"
COMPLETE = "workflow:complete"
FAIL = "workflow:fail"
GUIDED = "optimize:guided"
EXPLORATION = "optimize:exploration"
TOOL_CALL_PREFIX = "tool_call:"

EVENT_COLUMNS = [
    "event_id", "workflow_id", "timestamp", "activity", "agent_name", "agent_role",
    "tool_name", "tool_parameters", "tool_response", "llm_model", "llm_prompt_tokens",
    "llm_completion_tokens", "llm_reasoning", "llm_prompt", "duration_ms", "cost_usd",
    "status", "error_message", "step_number", "parent_event_id",
]
