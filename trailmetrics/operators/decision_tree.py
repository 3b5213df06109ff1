"""Decision trees from the point where the sub-clusters of a cluster part.

``members`` has workflow_id, the cluster ``key``, its ``subcluster``,
``tool_sequence`` and ``success``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmetrics.functions.sequences import collapse_repeats, suffix_after
from trailmetrics.functions.text import humanise
from trailmetrics.operators.traces import common_prefix_length
from trailmetrics.session import materialize
from trailmetrics.sources.schemas import TOOL_CALL_PREFIX

MAX_UNIQUE = 5


def representatives(members: DataFrame, key: str = "task_cluster") -> DataFrame:
    """Most common sequence (ties: smallest), size and success rate per sub-cluster."""
    counted = members.groupBy(key, "subcluster", "tool_sequence").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("success"), 1)).alias("ok")
    )
    return counted.groupBy(key, "subcluster").agg(
        F.min_by("tool_sequence", F.struct(-F.col("n"), F.col("tool_sequence"))).alias("sequence"),
        F.sum("n").alias("execution_count"),
        (F.sum("ok") / F.sum("n")).alias("success_rate"),
    )


def branching(reps: DataFrame, key: str = "task_cluster") -> DataFrame:
    """Common prefix and branch tool of clusters with two or more sub-clusters."""
    lengths = common_prefix_length(reps, key, "sequence")
    return (
        reps.groupBy(key).agg(F.min("sequence").alias("sequence"))
        .join(lengths, key)
        .filter((F.col("n_seq") >= 2) & (F.col("prefix_length") > 0))
        .select(
            key, "prefix_length", F.col("n_seq").alias("n_subclusters"),
            F.slice("sequence", F.lit(1), F.col("prefix_length")).alias("prefix"),
            F.get("sequence", F.col("prefix_length") - 1).alias("branch_tool"),
        )
    )


def branch_responses(
    event_logs: DataFrame, members: DataFrame, branches: DataFrame, key: str = "task_cluster"
) -> DataFrame:
    """First non-empty response of each run at its cluster's branch tool, as a map."""
    wanted = members.select("workflow_id", key, "subcluster").join(
        branches.select(key, "branch_tool"), key
    )
    filled = event_logs.filter(
        F.col("activity").startswith(TOOL_CALL_PREFIX) & F.col("tool_response").isNotNull()
        & ~F.trim("tool_response").isin("", "{}", "null")
    ).withColumn("branch_tool", F.substr("activity", F.lit(len(TOOL_CALL_PREFIX) + 1)))
    place = F.struct("step_number", "timestamp", "event_id")
    return (
        filled.join(wanted, ["workflow_id", "branch_tool"])
        .groupBy("workflow_id", key, "subcluster")
        .agg(F.min_by("tool_response", place).alias("response"))
        .withColumn("response", F.from_json("response", "map<string,string>"))
    )


def value_profiles(responses: DataFrame, key: str = "task_cluster") -> DataFrame:
    """Per sub-cluster and response field: count, distinct values, top value and share.

    Values are counted as rows; the list of distinct values is kept only where there
    are at most five of them, because more can never discriminate.
    """
    counts = (
        responses.select(key, "subcluster", F.explode("response").alias("field", "value"))
        .withColumn("value", F.coalesce("value", F.lit("null")))
        .groupBy(key, "subcluster", "field", "value")
        .agg(F.count("*").alias("n"))
    )
    ids = [key, "subcluster", "field"]
    sums = counts.groupBy(*ids).agg(
        F.sum("n").alias("total"), F.count("*").alias("n_unique"), F.max("n").alias("top_n"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top_value"),
    )
    small = sums.filter(F.col("n_unique") <= MAX_UNIQUE)
    lists = counts.join(small.select(*ids), ids, "left_semi").groupBy(*ids).agg(
        F.array_sort(F.collect_list("value")).alias("uniques")
    )
    return sums.join(lists, ids, "left")


def discriminating_fields(profiles: DataFrame, key: str = "task_cluster") -> DataFrame:
    """Best discriminating field of every pair of sub-clusters.

    A field qualifies if its values are disjoint, at most five in total and at most
    half of all values; the most consistent wins, ties by name.
    """
    side = profiles.filter(F.col("n_unique") <= MAX_UNIQUE).withColumn(
        "consistency", F.col("top_n") / F.col("total")
    )
    a, b = side.alias("a"), side.alias("b")
    unique = F.col("a.n_unique") + F.col("b.n_unique")
    qualifying = a.join(
        b,
        (F.col(f"a.{key}") == F.col(f"b.{key}"))
        & (F.col("a.field") == F.col("b.field"))
        & (F.col("a.subcluster") < F.col("b.subcluster"))
        & (unique <= MAX_UNIQUE)
        & (unique / (F.col("a.total") + F.col("b.total")) <= 0.5)
        & ~F.arrays_overlap("a.uniques", "b.uniques"),
    ).select(
        F.col(f"a.{key}").alias(key), F.col("a.subcluster").alias("left_sub"),
        F.col("b.subcluster").alias("right_sub"), F.col("a.field").alias("field"),
        F.round((F.col("a.consistency") + F.col("b.consistency")) / 2, 9).alias("separation"),
    )
    return qualifying.groupBy(key, "left_sub", "right_sub").agg(
        F.min_by("field", F.struct(-F.col("separation"), F.col("field"))).alias("field")
    )


def condition_keys(pair_fields: DataFrame, key: str = "task_cluster") -> DataFrame:
    """Field with most pair votes per cluster; two sub-clusters have a single vote."""
    return (
        pair_fields.groupBy(key, "field").agg(F.count("*").alias("votes"))
        .groupBy(key)
        .agg(F.min_by("field", F.struct(-F.col("votes"), F.col("field"))).alias("condition_key"))
    )


def branch_rows(
    event_logs: DataFrame, members: DataFrame, key: str = "task_cluster"
) -> DataFrame:
    """One row per branch, with the cluster's prefix, branch tool and condition."""
    reps = materialize(representatives(members, key), "representatives")
    split = materialize(branching(reps, key), "branching")
    profiles = materialize(
        value_profiles(branch_responses(event_logs, members, split, key), key), "value-profiles"
    )
    conditions = condition_keys(discriminating_fields(profiles, key), key)
    values = (
        profiles.join(conditions, key).filter(F.col("field") == F.col("condition_key"))
        .select(key, "subcluster", F.col("top_value").alias("condition_value"))
    )
    suffixes = reps.join(split, key).withColumn(
        "path", collapse_repeats(suffix_after(F.col("sequence"), F.col("prefix_length")))
    )
    tools = suffixes.select(key, "subcluster", F.posexplode("path").alias("pos", "tool"))
    owners = tools.groupBy(key, "tool").agg(F.countDistinct("subcluster").alias("owners"))
    own_tool = (
        tools.join(owners.filter("owners = 1"), [key, "tool"])
        .groupBy(key, "subcluster").agg(F.max_by("tool", "pos").alias("own_tool"))
    )
    label = F.when(F.size("path") == 0, "Direct completion").otherwise(
        humanise(F.coalesce("own_tool", F.get("path", F.size("path") - 1)))
    )
    return (
        suffixes.join(own_tool, [key, "subcluster"], "left")
        .join(conditions, key, "left")
        .join(values, [key, "subcluster"], "left")
        .filter((F.col("success_rate") > 0) | (F.col("execution_count") >= 5))
        .select(
            key, "subcluster", "prefix", "branch_tool", "condition_key", "path",
            "execution_count", "success_rate", "condition_value", label.alias("label"),
        )
    )


def decision_trees(event_logs: DataFrame, members: DataFrame, key: str = "task_cluster") -> DataFrame:
    """One struct per cluster, branches by size; no row where there is no tree."""
    rows = branch_rows(event_logs, members, key)
    ordered = F.array_sort(
        F.collect_list(
            F.struct(
                (-F.col("execution_count")).alias("o"), "subcluster", "path", "execution_count",
                "success_rate", "condition_value", "label",
            )
        )
    )
    return rows.groupBy(key).agg(
        F.first("prefix").alias("prefix"), F.first("branch_tool").alias("branch_tool"),
        F.first("condition_key").alias("condition_key"),
        F.transform(
            ordered,
            lambda b: F.struct(
                b["path"].alias("path"), b["execution_count"].alias("execution_count"),
                b["success_rate"].alias("success_rate"),
                b["condition_value"].alias("condition_value"), b["label"].alias("label"),
            ),
        ).alias("branches"),
    ).select(
        key,
        F.struct(
            collapse_repeats(F.col("prefix")).alias("common_prefix"), "branch_tool",
            F.concat(F.lit("Based on "), humanise(F.col("branch_tool")), F.lit(" result?"))
            .alias("condition_question"),
            "condition_key", "branches",
        ).alias("decision_tree"),
    )
