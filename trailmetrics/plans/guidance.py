"""Guidance: which known path, if any, to recommend for a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmetrics.functions import text
from trailmetrics.functions.measures import change_percent, conformance_band
from trailmetrics.functions.sequences import alignment
from trailmetrics.operators.matching import best_paths
from trailmetrics.operators.ordering import running_total
from trailmetrics.operators.similarity import nearest_path

# Default parameters.
SIMILARITY_THRESHOLD = 0.85
MIN_EXECUTIONS = 30
MIN_SUCCESS_RATE = 0.85
REGRESSION_MARGIN = 0.10


def eligible_paths(
    paths: DataFrame, min_executions: int = MIN_EXECUTIONS, min_success_rate: float = MIN_SUCCESS_RATE
) -> DataFrame:
    return paths.filter(
        (F.col("execution_count") >= min_executions) & (F.col("success_rate") >= min_success_rate)
    )


def similar_paths(
    tasks: DataFrame, paths: DataFrame,
    min_executions: int = MIN_EXECUTIONS, min_success_rate: float = MIN_SUCCESS_RATE,
) -> DataFrame:
    """Nearest eligible path of every task (workflow_id, embedding)."""
    return nearest_path(tasks, eligible_paths(paths, min_executions, min_success_rate))


def guidance(
    tasks: DataFrame, paths: DataFrame,
    threshold: float = SIMILARITY_THRESHOLD, min_executions: int = MIN_EXECUTIONS,
    margin: float = REGRESSION_MARGIN, min_success_rate: float = MIN_SUCCESS_RATE,
) -> DataFrame:
    """Mode, reason and payload per task.

    Exploration is chosen without an embedding, without an eligible path, below the
    similarity threshold, or where guided runs do worse than exploration by more
    than the margin (only if both rates are known).
    """
    found = similar_paths(tasks, paths, min_executions, min_success_rate)
    has_vector = F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    asked = tasks.select("workflow_id", has_vector.alias("has_vector"))
    joined = asked.join(found, "workflow_id", "left").join(paths.drop("embedding"), "path_id", "left")
    reason = (
        F.when(~F.col("has_vector"), "embedding_failed")
        .when(F.col("path_id").isNull(), "no_matching_paths")
        .when(F.col("similarity") < threshold, "below_threshold")
        .when(F.col("guided_success_rate") < F.col("exploration_success_rate") - margin, "regression_detected")
        .otherwise("guided")
    )
    decided = joined.withColumn("reason", reason)
    guided = F.col("reason") == "guided"

    def payload(column: str | Column, name: str) -> Column:
        value = F.col(column) if isinstance(column, str) else column
        return F.when(guided, value).alias(name)

    def unless_empty(column: str) -> Column:
        return F.when(F.size(column) > 0, F.col(column))

    return decided.select(
        "workflow_id",
        F.when(guided, "guided").otherwise("exploration").alias("mode"),
        "reason",
        payload("tool_sequence", "path"),
        payload(F.round("similarity", 4), "confidence"),
        payload("avg_duration_ms", "avg_duration_ms"),
        payload("avg_steps", "avg_steps"),
        payload("success_rate", "success_rate"),
        payload("execution_count", "execution_count"),
        payload(unless_empty("failure_warnings"), "failure_warnings"),
        payload(unless_empty("alternative_paths"), "alternative_paths"),
        payload("decision_tree", "decision_tree"),
    )


def _percent(share: Column) -> Column:
    return F.concat(F.format_string("%.0f", F.bround(share * 100, 0)), F.lit("%"))


def guidance_text(decided: DataFrame) -> DataFrame:
    """Add the hint text: decision tree, else alternatives, else the single path."""
    runs = F.coalesce("execution_count", F.lit(0))
    rate = _percent(F.coalesce("success_rate", F.lit(0.0)))
    single = F.concat_ws(
        "\n",
        F.lit("OPTIMIZATION HINT — This tool sequence has worked well for similar tasks:"),
        text.numbered(F.col("path")),
        F.when(
            F.col("success_rate").isNotNull() & F.col("execution_count").isNotNull(),
            F.concat(F.lit("Based on "), "execution_count", F.lit(" runs ("), rate, F.lit(" success rate).")),
        ),
    )
    letters = F.split(F.lit("B C D E F G H I J K L M N O P Q R S T U V W X Y Z"), " ")
    others = F.transform(
        "alternative_paths",
        lambda alt, i: F.concat(
            F.lit("  Path "), F.coalesce(F.get(letters, i), (i + 2).cast("string")),
            F.lit(" ("), alt["execution_count"], F.lit(" runs, "), _percent(alt["success_rate"]),
            F.lit(" success):\n"), text.numbered(alt["tool_sequence"], indent="    "),
        ),
    )
    several = F.concat_ws(
        "\n",
        F.lit("OPTIMIZATION HINT — Multiple approaches have worked for similar tasks:\n"),
        F.concat(
            F.lit("  Path A (primary, "), runs, F.lit(" runs, "), rate, F.lit(" success):\n"),
            text.numbered(F.col("path"), indent="    "),
        ),
        F.array_join(others, "\n"),
    )
    tree = F.col("decision_tree")
    branches = tree["branches"]
    n_branches = F.size(branches)
    first_step = F.size(tree["common_prefix"]) + 1
    branch_text = F.transform(
        branches,
        lambda b, i: F.concat(
            F.lit("     |   |\n     |   "),
            F.when((n_branches == 2) & (i == 0), "YES").when(n_branches == 2, "NO").otherwise(b["label"]),
            F.lit(" --> "), b["label"], F.lit(" ("), b["execution_count"], F.lit(" runs, "),
            _percent(b["success_rate"]), F.lit(" success):"),
            F.when(F.size(b["path"]) > 0, F.concat(F.lit("\n"), text.numbered(
                b["path"], first_step,
                F.when(i == n_branches - 1, "          ").otherwise("     |    "),
            ))).otherwise(""),
            F.when(i < n_branches - 1, "\n     |").otherwise(""),
        ),
    )
    branching = F.concat_ws(
        "\n",
        F.lit("OPTIMIZATION HINT — Suggested approach for this task type:\n"),
        text.numbered(tree["common_prefix"]),
        F.when(n_branches > 0, F.concat(F.lit("     |\n     +-- "), tree["condition_question"])),
        F.when(n_branches > 0, F.array_join(branch_text, "\n")),
    )
    warnings = F.when(
        F.size("failure_warnings") > 0,
        F.concat(
            F.lit("\nCOMMON FAILURE PATTERNS:\n"),
            F.array_join(F.transform("failure_warnings", lambda w: F.concat(F.lit("  - "), w)), "\n"),
        ),
    )
    # Fixed value: the closing advice of every hint.
    advice = F.lit(
        "\nGUIDELINES:"
        "\n- Use this as a suggested approach — adapt if the situation requires it."
        "\n- After each tool, check the response to decide which branch to follow."
        "\n- Skip steps that are already complete."
        "\n- If a tool returns an error, reason about what to do next — do not retry the same call."
    )
    main = (
        F.when(tree.isNotNull(), branching)
        .when(F.size("alternative_paths") > 0, several)
        .otherwise(single)
    )
    has_path = (F.col("mode") == "guided") & (F.size("path") > 0)
    return decided.withColumn(
        "guidance_text", F.when(has_path, F.concat_ws("\n", main, warnings, advice)).otherwise("")
    )


def best_path_match(sequences: DataFrame, paths: DataFrame) -> DataFrame:
    """Best matching stored path of each sequence (``tool_sequence``, not empty).

    Score = equal positions over the shorter length; ties go to the path that comes
    first (most executions, then name).  Each distinct sequence is scored once.
    """
    ordered = paths.select(
        "task_cluster", "path_id", "tool_sequence", "avg_duration_ms", "avg_steps", "success_rate",
        "execution_count", (-F.col("execution_count")).alias("o"), F.lit(1).alias("one"),
    )
    placed = running_total(ordered, [], ["o", "task_cluster"], "one", "at").drop("o", "one")
    scored = (
        best_paths(sequences, placed.select("at", "tool_sequence"))
        .join(
            placed.select(
                "at", "path_id", "task_cluster", F.col("tool_sequence").alias("optimal_sequence"),
                F.col("avg_duration_ms").alias("optimal_duration_ms"), F.col("avg_steps").alias("optimal_steps"),
                F.col("success_rate").alias("optimal_success_rate"),
                F.col("execution_count").alias("optimal_executions"),
            ),
            "at",
        )
        .drop("at")
    )
    return scored.withColumn("alignment", alignment(F.col("tool_sequence"), F.col("optimal_sequence")))


def optimization_context(
    traces: DataFrame, paths: DataFrame, mode_stats: DataFrame
) -> DataFrame:
    """Each run against its best path and against the mean exploration run.

    ``mode_stats`` is the one-row mode comparison.
    """
    matches = best_path_match(traces, paths)
    baseline = mode_stats.select(
        F.lit(1).alias("one"), F.col("exp_avg_duration"), F.col("exp_avg_steps"),
        F.col("exp_success_rate"), (F.col("gui_count") > 0).alias("has_guided"),
    )
    actual = F.when(F.col("success"), 100.0).otherwise(0.0)
    hits = F.size(F.filter("alignment", lambda s: s == "match"))
    aligned = F.round(hits / F.size("alignment") * 100)
    return (
        traces.join(matches, "tool_sequence")
        .withColumn("one", F.lit(1))
        .join(F.broadcast(baseline), "one")  # one row
        .select(
            "workflow_id", "task_cluster",
            F.round(F.col("score") * 100).alias("conformance_pct"),
            aligned.alias("aligned_pct"),
            conformance_band(aligned).alias("band"),
            F.array_join("alignment", ",").alias("alignment"),
            change_percent(F.col("optimal_duration_ms"), F.col("total_duration_ms")).alias("duration_vs_optimal"),
            change_percent(F.col("optimal_steps"), F.col("total_steps").cast("double")).alias("steps_vs_optimal"),
            (actual - F.col("optimal_success_rate") * 100).alias("success_vs_optimal"),
            change_percent(F.col("exp_avg_duration"), F.col("total_duration_ms")).alias("duration_vs_exploration"),
            change_percent(F.col("exp_avg_steps"), F.col("total_steps").cast("double")).alias("steps_vs_exploration"),
            (actual - F.col("exp_success_rate") * 100).alias("success_vs_exploration"),
            "has_guided",
        )
    )
