"""Transition graphs, directly-follows graphs and conformance to a model.

Graphs and models are counted from rows (one move per row), so their cost does not depend on
how the rows are spread over workflows.  Conformance aligns distinct sequences with a model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmetrics.operators.events import tool_calls
from trailmetrics.operators.ordering import hour_block, step_block, with_next
from trailmetrics.operators.traces import ordered_sequences
from trailmetrics.session import materialize

START_NODE = "__START__"
END_NODE = "__END__"
SALTS = 8  # shares of a key that may hold a third of all rows


def transitions(event_logs: DataFrame) -> DataFrame:
    """Tool-to-tool transitions with their counts (self loops kept)."""
    calls = tool_calls(event_logs).select(
        "workflow_id", "step_number", "timestamp", "event_id", "tool_name"
    )
    chained = with_next(
        calls, ["workflow_id"], step_block(), ["step_number", "timestamp", "event_id"],
        ["tool_name"], "previous",
    )
    return (
        chained.filter(F.col("previous").isNotNull())
        .groupBy(F.col("previous.tool_name").alias("source"), F.col("tool_name").alias("target"))
        .agg(F.count("*").alias("weight"))
    )


def graph_nodes(event_logs: DataFrame) -> DataFrame:
    return (
        tool_calls(event_logs)
        .groupBy(F.col("tool_name").alias("id"))
        .agg(F.avg("duration_ms").alias("avg_duration_ms"), F.count("*").alias("call_count"))
    )


def moves(event_logs: DataFrame, by_time: bool = False) -> DataFrame:
    """Counts of directly-follows moves per workflow, with start and end sentinels.

    Tool rows are those with a tool name, in trace order (step, time) or, for the
    process model, in time order.
    """
    order = (
        ["timestamp", "step_number", "event_id"] if by_time
        else ["step_number", "timestamp", "event_id"]
    )
    rows = event_logs.filter(F.col("tool_name").isNotNull()).select(
        "workflow_id", "tool_name", *order
    )
    block = hour_block() if by_time else step_block()
    onward = with_next(rows, ["workflow_id"], block, order, ["tool_name"]).select(
        "workflow_id",
        F.col("tool_name").alias("source"),
        F.coalesce("next.tool_name", F.lit(END_NODE)).alias("target"),
    )
    first = (
        rows.groupBy("workflow_id")
        .agg(F.min_by("tool_name", F.struct(*order)).alias("target"))
        .select("workflow_id", F.lit(START_NODE).alias("source"), "target")
    )
    return (
        onward.unionByName(first)
        .groupBy("workflow_id", "source", "target")
        .agg(F.count("*").alias("n"))
    )


def last_call_metrics(event_logs: DataFrame) -> DataFrame:
    """Duration and cost of a tool's last call in each workflow."""
    return (
        event_logs.filter(F.col("tool_name").isNotNull())
        .groupBy("workflow_id", F.col("tool_name").alias("target"))
        .agg(
            F.max_by(
                F.struct("duration_ms", "cost_usd"),
                F.struct("step_number", "timestamp", "event_id"),
            ).alias("last")
        )
        .select(
            "workflow_id", "target",
            F.col("last.duration_ms").alias("duration_ms"),
            F.col("last.cost_usd").alias("cost_usd"),
        )
    )


def directly_follows_graph(
    event_logs: DataFrame, members: DataFrame, key: str = "task_cluster"
) -> DataFrame:
    """Weighted edges per cluster.

    ``members`` maps workflow_id to its cluster and ``success``.  The duration and
    cost of an edge are those of its target tool, taken from that tool's last call
    in the trace; edges into the end sentinel count 0.
    """
    per_workflow = moves(event_logs).join(members, "workflow_id")
    measured = per_workflow.join(last_call_metrics(event_logs), ["workflow_id", "target"], "left")
    ms = F.coalesce("duration_ms", F.lit(0.0)) * F.col("n")
    usd = F.coalesce(F.col("cost_usd"), F.lit(0).cast("decimal(10,6)")) * F.col("n")
    return measured.groupBy(key, "source", "target").agg(
        F.sum("n").alias("frequency"),
        (F.sum(F.when(F.col("success"), F.col("n")).otherwise(0)) / F.sum("n")).alias("success_rate"),
        (F.sum(ms) / F.sum("n")).alias("avg_duration_ms"),
        (F.sum(usd).cast("double") / F.sum("n")).alias("avg_cost_usd"),
    )


def process_model(
    event_logs: DataFrame, members: DataFrame, key: str = "task_cluster", min_frequency: int = 1
) -> DataFrame:
    """Normative model per cluster: moves seen at least ``min_frequency`` times in
    successful runs, ordered by time.  A cluster without successful runs has none."""
    return (
        moves(event_logs, by_time=True)
        .join(members.filter("success"), "workflow_id")
        .groupBy(key, "source", "target")
        .agg(F.sum("n").alias("frequency"))
        .filter(F.col("frequency") >= min_frequency)
    )


def runs_by_time(event_logs: DataFrame, members: DataFrame, key: str = "task_cluster") -> DataFrame:
    """(key, workflow_id, tool_sequence) of all runs with a tool, in time order."""
    calls = event_logs.filter(F.col("tool_name").isNotNull()).select(
        "workflow_id", "tool_name", "timestamp", "step_number", "event_id")
    return ordered_sequences(calls, by_time=True).join(members.select("workflow_id", key), "workflow_id")


def model_distances(model: DataFrame, key: str = "task_cluster") -> DataFrame:
    """(key, source, target, skipped): fewest tools that the model needs between two nodes.

    Works on models, at most one row per pair of tools, not on runs.
    """
    def closed(edges: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        names, sources, targets = (edges[c].to_numpy(dtype=object) for c in (key, "source", "target"))
        found = []
        for a, b in zip(starts, [*starts[1:], len(names)]):
            nodes = np.array(sorted({*sources[a:b], *targets[a:b]}), dtype=object)
            place = {n: i for i, n in enumerate(nodes)}
            steps = np.full((len(nodes), len(nodes)), np.inf)
            steps[[place[n] for n in sources[a:b]], [place[n] for n in targets[a:b]]] = 1
            for middle in range(len(nodes)):
                steps = np.minimum(steps, steps[:, middle, None] + steps[None, middle, :])
            i, j = np.nonzero(np.isfinite(steps))
            found.append((np.full(len(i), names[a], dtype=object), nodes[i], nodes[j], steps[i, j].astype("int64") - 1))
        return pd.DataFrame(dict(zip([key, "source", "target", "skipped"], map(np.concatenate, zip(*found)))))

    def shortest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One call for many small models; only that at the end of a batch is held back."""
        held = None
        for frame in frames:
            rows = frame if held is None else pd.concat([held, frame], ignore_index=True)
            if rows.empty:
                continue
            names = rows[key].to_numpy(dtype=object)
            starts = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
            held = rows.iloc[starts[-1]:]
            if len(starts) > 1:
                yield closed(rows.iloc[: starts[-1]], starts[:-1])
        if held is not None:
            yield closed(held, np.array([0]))

    tasks = int(model.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        model.select(key, "source", "target").repartition(tasks, key).sortWithinPartitions(key)
        .mapInPandas(shortest, f"{key} string, source string, target string, skipped bigint")
    )


def _moves_along() -> Column:
    """Moves of ``tool_sequence`` with start and end sentinels, as (source, target)."""
    return F.arrays_zip(
        F.concat(F.array(F.lit(START_NODE)), "tool_sequence").alias("source"),
        F.concat("tool_sequence", F.array(F.lit(END_NODE))).alias("target"))


def alignments(variants: DataFrame, model: DataFrame, key: str = "task_cluster") -> DataFrame:
    """Optimal alignment of every distinct sequence with its cluster's model.

    Adds ``cost`` (least number of moves on one side only), ``missing`` (those of the model;
    the fewest at that cost) and ``worst`` (cost without any common move).  Clusters without
    a model have no row, nor have those whose model (thinned out) does not lead to its end.

    A sequence whose moves are all in the model is aligned with itself and costs nothing.  For
    the others: between two common moves the model takes a shortest path and the run's tools are left
    over, so the best alignment is a shortest path over the run's tools that remembers one
    state per tool.  It is one fold along the sequence; the distances it asks for, one per
    pair of tools in the sequence, come in by a join.
    """
    distances = materialize(model_distances(model, key), "model-distances")
    tasks = int(variants.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few rows, but much work on each
    numbered = materialize(
        variants.repartition(tasks).withColumn("variant", F.monotonically_increasing_id())
        .withColumn("salt", F.pmod(F.xxhash64("variant"), F.lit(SALTS)).cast("int")), "variants")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    moved = numbered.select(key, "variant", "salt", F.explode(_moves_along()).alias("move")).select(
        key, "variant", "salt", "move.*")
    known = model.select(key, "source", "target").withColumn("salt", salts)
    leaving = moved.join(known, [key, "source", "target", "salt"], "left_anti").select("variant").distinct()
    marked = materialize(numbered.join(leaving.withColumn("leaves", F.lit(True)), "variant", "left"), "variants-marked")
    ends = distances.filter((F.col("source") == START_NODE) & (F.col("target") == END_NODE)).select(
        key, "skipped", salts.alias("salt"))
    inside = marked.filter("leaves is null").join(ends, [key, "salt"]).select(
        *variants.columns, F.lit(0).cast("bigint").alias("cost"), F.lit(0).cast("bigint").alias("missing"),
        (F.size("tool_sequence") + F.col("skipped")).alias("worst"))
    numbered = marked.filter("leaves")
    pairs = numbered.select(
        key, "variant", "salt", F.explode(F.expr(f"array_union(array('{START_NODE}'), tool_sequence)")).alias("source"),
        "tool_sequence",
    ).select(key, "variant", "salt", "source",
             F.explode(F.expr(f"array_union(tool_sequence, array('{END_NODE}'))")).alias("target"))
    spread = distances.withColumn("salt", salts)
    asked = pairs.join(spread, [key, "source", "target", "salt"]).groupBy("variant").agg(
        F.map_from_entries(F.collect_list(F.struct(F.struct("source", "target"), "skipped"))).alias("skipped"))
    # states: tool, cost and missing of the best alignment that ends with a common move on it, less its place
    best = """
        array_min(filter(transform(states, s -> named_struct(
            'cost', s.cost + skipped[named_struct('source', s.tool, 'target', {to})] + {at},
            'missing', s.missing + skipped[named_struct('source', s.tool, 'target', {to})])), c -> c.cost is not null))"""
    step = best.replace("states", "acc.states").format(to="tool", at="acc.at")
    fold = f"""
        aggregate(tool_sequence,
            named_struct('at', 0L, 'states', array(named_struct('tool', '{START_NODE}', 'cost', 0L, 'missing', 0L))),
            (acc, tool) -> named_struct('at', acc.at + 1, 'states',
                transform(array({step}), found -> if(found is null, acc.states, if(
                    exists(acc.states, s -> s.tool = tool
                        and (s.cost < found.cost - acc.at - 1 or s.cost = found.cost - acc.at - 1 and s.missing <= found.missing)),
                    acc.states,
                    concat(filter(acc.states, s -> s.tool <> tool), array(named_struct(
                        'tool', tool, 'cost', found.cost - acc.at - 1, 'missing', found.missing))))))[0])).states"""
    total = best.format(to=f"'{END_NODE}'", at="size(tool_sequence)")
    shortest = F.expr(f"skipped[named_struct('source', '{START_NODE}', 'target', '{END_NODE}')]")
    return (
        numbered.join(asked, "variant").withColumn("worst", F.size("tool_sequence") + shortest).filter("worst is not null")
        .withColumn("states", F.expr(fold)).withColumn("found", F.expr(total))
        .select(*variants.columns, "found.*", "worst")
        .unionByName(inside)
    )


@dataclass(frozen=True)
class AlignedRuns:
    """Stored alignments of all runs with the models of their clusters."""

    runs: DataFrame  # key, workflow_id, tool_sequence in time order
    variants: DataFrame  # key, tool_sequence, n
    found: DataFrame  # the same with cost, missing and worst, where there is an alignment


def align_runs(
    event_logs: DataFrame, members: DataFrame, model: DataFrame, key: str = "task_cluster"
) -> AlignedRuns:
    """Alignments that ``model_quality`` and ``model_deviations`` share; ``model`` is stored."""
    runs = materialize(runs_by_time(event_logs, members, key), "time-runs")
    variants = materialize(runs.groupBy(key, "tool_sequence").agg(F.count("*").alias("n")), "time-variants")
    return AlignedRuns(runs, variants, materialize(alignments(variants, model, key), "alignments"))


def model_quality(
    event_logs: DataFrame, members: DataFrame, model: DataFrame, key: str = "task_cluster",
    aligned: AlignedRuns | None = None,
) -> DataFrame:
    """Fitness and precision of all runs against the model, per cluster.

    fitness = mean over runs of (1 - cost of the optimal alignment / its worst cost);
    precision = sum over states of visits * observed allowed moves
                / sum over states of visits * allowed moves  (escaping edges).
    Clusters without a model have no row.  ``aligned``: what ``align_runs`` found for these
    runs and this model, if it is there already.
    """
    if aligned is None:
        model = materialize(model, "model")
        aligned = align_runs(event_logs, members, model, key)
    fitness = aligned.found.groupBy(key).agg(
        (F.sum(F.col("n") * (1 - F.col("cost") / F.col("worst"))) / F.sum("n")).alias("fitness"))
    taken = aligned.variants.select(key, "n", F.explode(_moves_along()).alias("move")).groupBy(
        key, "move.source", "move.target").agg(F.sum("n").alias("n"))
    allowed = model.select(key, "source", "target", F.lit(True).alias("allowed"))
    observed = taken.join(allowed, [key, "source", "target"], "left").groupBy(key, "source").agg(
        F.sum("n").alias("visits"), F.count("allowed").alias("used"))
    outgoing = model.groupBy(key, "source").agg(F.count("*").alias("options"))
    precision = (
        observed.join(outgoing, [key, "source"])
        .groupBy(key)
        .agg((F.sum(F.col("visits") * F.col("used")) / F.sum(F.col("visits") * F.col("options")))
             .alias("precision"))
    )
    return fitness.join(precision, key)


def model_deviations(
    event_logs: DataFrame, members: DataFrame, model: DataFrame, key: str = "task_cluster",
    aligned: AlignedRuns | None = None,
) -> DataFrame:
    """Runs that leave the model: moves of the model that they miss and own tools left over
    (``remaining``) in their optimal alignment.  ``aligned`` as in ``model_quality``."""
    if aligned is None:
        aligned = align_runs(event_logs, members, materialize(model, "model"), key)
    spread = aligned.found.filter("cost > 0").select(
        key, "tool_sequence", "missing", (F.col("cost") - F.col("missing")).alias("remaining"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = aligned.runs.withColumn("salt", F.pmod(F.xxhash64("workflow_id"), F.lit(SALTS)).cast("int"))
    return salted.join(spread, [key, "tool_sequence", "salt"]).select(key, "workflow_id", "missing", "remaining")


def optimal_edges(paths: DataFrame) -> DataFrame:
    """Distinct consecutive tool pairs over many paths."""
    return (
        paths.filter(F.size("tool_sequence") > 1)
        .select(
            F.explode(
                F.arrays_zip(
                    F.slice("tool_sequence", F.lit(1), F.size("tool_sequence") - 1).alias("source"),
                    F.slice("tool_sequence", F.lit(2), F.size("tool_sequence") - 1).alias("target"),
                )
            ).alias("edge")
        )
        .select(F.col("edge.source").alias("source"), F.col("edge.target").alias("target"))
        .distinct()
    )
