"""Warnings from comparing failed with successful runs of a cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_WARNINGS = 3


def _class_sizes(members: DataFrame, key: str) -> DataFrame:
    """Successes and failures per cluster, where both classes are present."""
    return (
        members.groupBy(key)
        .agg(
            F.count(F.when(F.col("success"), 1)).alias("n_success"),
            F.count(F.when(~F.col("success"), 1)).alias("n_failed"),
        )
        .filter((F.col("n_success") > 0) & (F.col("n_failed") > 0))
    )


def _path_tools(optimal: DataFrame, key: str) -> DataFrame:
    return optimal.select(key, F.posexplode("tool_sequence").alias("pos", "tool_name"))


def missing_step_warnings(
    event_logs: DataFrame, members: DataFrame, optimal: DataFrame, key: str = "task_cluster",
    in_success: float = 0.70, missing_in_failed: float = 0.40, min_missing: int = 2,
) -> DataFrame:
    """Tools of the optimal path common in successes and often absent from failures."""
    used = (
        event_logs.filter(F.col("tool_name").isNotNull())
        .groupBy("workflow_id", "tool_name").agg(F.lit(1).alias("used"))
        .join(members.select("workflow_id", key, "success"), "workflow_id")
        .groupBy(key, "tool_name")
        .agg(
            F.count(F.when(F.col("success"), 1)).alias("success_has"),
            F.count(F.when(~F.col("success"), 1)).alias("failed_has"),
        )
    )
    zero = F.lit(0)
    judged = (
        _path_tools(optimal, key).join(_class_sizes(members, key), key)
        .join(used, [key, "tool_name"], "left")
        .withColumn("success_has", F.coalesce("success_has", zero))
        .withColumn("missing", F.col("n_failed") - F.coalesce("failed_has", zero))
    )
    return judged.filter(
        (F.col("success_has") / F.col("n_success") > in_success)
        & (F.col("missing") / F.col("n_failed") > missing_in_failed)
        & (F.col("missing") >= min_missing)
    ).select(
        key, F.lit(0).alias("kind"), "pos", F.lit("").alias("param"),
        F.format_string(
            "%s was missing in %d/%d failed runs but present in %d/%d successful runs",
            F.col("tool_name"), F.col("missing"), F.col("n_failed"),
            F.col("success_has"), F.col("n_success"),
        ).alias("warning"),
    )


def parameter_warnings(
    event_logs: DataFrame, members: DataFrame, optimal: DataFrame, key: str = "task_cluster",
    success_share: float = 0.60, failed_share: float = 0.40,
) -> DataFrame:
    """Parameters whose dominant value differs between successes and failures.

    Values are compared as JSON text, and only calls of path tools are parsed.  Counts per value are formed before the top
    value is picked, so no list of values is gathered.
    """
    values = (
        event_logs.filter(F.col("tool_name").isNotNull() & F.col("tool_parameters").isNotNull())
        .join(members.select("workflow_id", key, "success"), "workflow_id")
        .join(_path_tools(optimal, key).select(key, "tool_name"), [key, "tool_name"], "left_semi")
        .select(
            key, "tool_name", "success",
            F.explode(F.from_json("tool_parameters", "map<string,string>")).alias("param", "value"),
        )
        .groupBy(key, "tool_name", "param", "success", "value")
        .agg(F.count("*").alias("n"))
        .groupBy(key, "tool_name", "param", "success")
        .agg(
            F.sum("n").alias("total"),
            F.min_by(F.struct("value", "n"), F.struct(-F.col("n"), F.col("value"))).alias("top"),
        )
    )
    ids = [key, "tool_name", "param"]
    good = values.filter("success").select(
        *ids, F.col("top.value").alias("s_value"), F.col("top.n").alias("s_n"), F.col("total").alias("s_total"))
    bad = values.filter("not success").select(
        *ids, F.col("top.value").alias("f_value"), F.col("top.n").alias("f_n"), F.col("total").alias("f_total"))
    return (
        _path_tools(optimal, key).join(good.join(bad, ids), [key, "tool_name"])
        .filter(
            (F.col("s_n") / F.col("s_total") > success_share)
            & (F.col("f_n") / F.col("f_total") > failed_share)
            & ~F.col("s_value").eqNullSafe(F.col("f_value"))  # a JSON null is a value like others
        )
        .select(
            key, F.lit(1).alias("kind"), "pos", "param",
            F.format_string(
                "at %s, successful runs used %s=%s (%d/%d runs) while failed runs used %s=%s",
                F.col("tool_name"), F.col("param"), F.coalesce("s_value", F.lit("null")), F.col("s_n"),
                F.col("s_total"), F.col("param"), F.coalesce("f_value", F.lit("null")),
            ).alias("warning"),
        )
    )


def failure_warnings(
    event_logs: DataFrame, members: DataFrame, optimal: DataFrame, key: str = "task_cluster",
    success_share: float = 0.60, failed_share: float = 0.40,
) -> DataFrame:
    """Up to three warnings per cluster: missing steps first, then parameters, each in
    path order.  Later ones are cut by rank, before the list is built."""
    found = missing_step_warnings(event_logs, members, optimal, key).unionByName(
        parameter_warnings(event_logs, members, optimal, key, success_share, failed_share)
    )
    rank = F.row_number().over(Window.partitionBy(key).orderBy("kind", "pos", "param", "warning"))
    listed = F.array_sort(F.collect_list(F.struct("rank", "warning")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= MAX_WARNINGS).groupBy(key).agg(
        F.transform(listed, lambda w: w["warning"]).alias("failure_warnings")
    )
