"""Pareto-optimal tool sequences per cluster.

Traces are first reduced to distinct sequences with additive totals (``variants``), so a
sequence followed by a third of all runs is one row.

The search grows patterns over projected variants: a row is a variant with a path that it
contains and the rest of its sequence behind the path's last tool.  Each level appends one
tool along an edge and keeps the paths that enough runs contain, so paths that no run
supports are never built, and the totals of a path are sums over its rows.  Given paths are
matched by the same growth, along their prefixes instead of the graph's edges.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmetrics.operators.graphs import END_NODE, START_NODE
from trailmetrics.operators.traces import most_frequent_sequence, variants
from trailmetrics.session import materialize

SALTS = 8
STRIDE = 2
FRONT_BLOCK = 2048


def keep_reliable_edges(edges: DataFrame, min_success_rate: float) -> DataFrame:
    return edges.filter(F.col("success_rate") >= min_success_rate)


def enumerate_paths(
    edges: DataFrame, max_tools: int, key: str = "task_cluster"
) -> DataFrame:
    """All simple start-to-end paths with at most ``max_tools`` tools, as (key, tool_sequence).

    Level by level: each round extends the open paths of all clusters by one edge and
    stores them.  The result is exponential by nature; ``find_pareto_paths`` does without it.
    """
    steps = materialize(edges.select(key, "source", "target"), "path-edges")
    inner = steps.filter((F.col("source") != START_NODE) & (F.col("target") != END_NODE))
    closing = steps.filter(F.col("target") == END_NODE).select(key, F.col("source").alias("last"))
    open_paths = materialize(
        steps.filter((F.col("source") == START_NODE) & (F.col("target") != END_NODE)).select(
            key, F.array("target").alias("tool_sequence"), F.col("target").alias("last")
        ),
        "open-paths",
    )
    complete = [open_paths]
    for _ in range(1, max_tools):
        grown = (
            open_paths.join(inner.withColumnRenamed("source", "last"), [key, "last"])
            .filter(~F.array_contains("tool_sequence", F.col("target")))
            .select(
                key, F.array_append("tool_sequence", F.col("target")).alias("tool_sequence"),
                F.col("target").alias("last"),
            )
        )
        open_paths = materialize(grown, "open-paths")
        if open_paths.isEmpty():
            break
        complete.append(open_paths)
    return reduce(DataFrame.unionByName, complete).join(closing, [key, "last"], "left_semi").select(key, "tool_sequence")


def group_sizes(traces: DataFrame, key: str = "task_cluster") -> DataFrame:
    """Runs and mean sequence length per cluster."""
    return traces.groupBy(key).agg(F.count("*").alias("n_traces"), F.avg(F.size("tool_sequence")).alias("avg_length"))


def variant_sizes(groups: DataFrame, key: str = "task_cluster") -> DataFrame:
    """The same from variants."""
    length = F.sum(F.col("n") * F.size("tool_sequence"))
    return groups.groupBy(key).agg(F.sum("n").alias("n_traces"), (length / F.sum("n")).alias("avg_length"))


def covering_length(avg_length: Column) -> Column:
    """Half the mean run, at least two tools."""
    return F.greatest(F.lit(2), F.floor(avg_length * 0.5))


def covering_paths(paths: DataFrame, sizes: DataFrame, key: str = "task_cluster") -> DataFrame:
    """Drop paths shorter than half the mean run (at least 2), unless none would remain."""
    needed = covering_length(F.col("avg_length"))
    judged = (
        paths.filter(F.size("tool_sequence") > 0)
        .join(sizes.select(key, "avg_length"), key)
        .withColumn("long_enough", F.size("tool_sequence") >= needed)
    )
    any_long = judged.groupBy(key).agg(F.bool_or("long_enough").alias("any_long"))
    return (
        judged.join(any_long, key)
        .filter(F.col("long_enough") | ~F.col("any_long"))
        .select(key, "tool_sequence")
    )


def with_fallback(paths: DataFrame, traces: DataFrame, key: str = "task_cluster") -> DataFrame:
    """Add the most frequent sequence for clusters without any path."""
    missing = most_frequent_sequence(traces, key).join(paths.select(key).distinct(), key, "left_anti")
    return paths.unionByName(missing.select(key, "tool_sequence"))


# --- growth ------------------------------------------------------------------------------

TOTALS = ["n", "sum_ms", "sum_cost", "sum_steps", "n_success"]


def _spread(small: DataFrame) -> DataFrame:
    """The small side of a join whose key may hold a third of the other side's rows."""
    return small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _dealt(rows: DataFrame) -> DataFrame:
    """Over all tasks: few variants become many rows, and growth itself moves none."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _extended(rows: DataFrame, steps: DataFrame, key: str, on: str, simple: bool) -> DataFrame:
    """Every row with each tool that ``steps`` (key, ``on``, next) allows and its rest still holds.

    A row whose path cannot reach half its variant's length any more is dropped: no path
    beyond it would count the variant.
    """
    unused = "array_except({}, tool_sequence)" if simple else "{}"
    allowed, in_reach = unused.format("array_intersect(next, rest)"), unused.format("rest")
    return (
        rows.join(steps, [key, on, "salt"])
        .selectExpr(key, "salt", "needed", "length", *TOTALS, "rest", "tool_sequence", f"explode({allowed}) AS last")
        .selectExpr(
            key, "salt", "needed", "length", *TOTALS, "last", "array_append(tool_sequence, last) AS tool_sequence",
            "slice(rest, cast(array_position(rest, last) + 1 as int), size(rest)) AS rest")
        .filter(f"2 * (size(tool_sequence) + size({in_reach})) >= length")
    )


def _counted(rows: DataFrame, key: str) -> DataFrame:
    """Per path: runs that contain it (``support``), totals of the runs that are it and of
    those that contain it and are at most twice as long."""
    same, near = "length = size(tool_sequence)", "length <= 2 * size(tool_sequence)"
    return rows.groupBy(key, "tool_sequence").agg(*[F.expr(e) for e in (
        "max(needed) AS needed", "sum(n) AS support", *[f"sum({c}) FILTER (WHERE {same}) AS same_{c}" for c in TOTALS],
        *[f"sum({c}) FILTER (WHERE {near}) AS near_{c}" for c in TOTALS])])


def grown_paths(
    groups: DataFrame, steps: DataFrame, needed: DataFrame, key: str, on: str, simple: bool = True
) -> DataFrame:
    """Paths that at least ``needed`` (key, needed) runs of their cluster contain, with the
    totals of the runs that count for them.

    ``groups`` are variants; ``steps`` holds the tools (array ``next``) that may follow what
    ``on`` names: the path's ``last`` tool (START_NODE before the first) or the whole
    ``tool_sequence`` (empty before the first).  ``simple`` paths repeat no tool.  A round
    appends up to ``STRIDE`` tools before it counts.
    """
    salted = _spread(steps)
    rows = (
        groups.filter(F.size("tool_sequence") > 0)
        .withColumn("salt", F.pmod(F.xxhash64("tool_sequence"), F.lit(SALTS)).cast("int"))
        .join(_spread(needed), [key, "salt"])
        .selectExpr(
            key, "salt", "needed", "size(tool_sequence) AS length", *TOTALS, f"'{START_NODE}' AS last",
            "cast(array() as array<string>) AS tool_sequence", "tool_sequence AS rest")
    )
    found, length = [], 0
    while True:
        lengths = []
        for _ in range(STRIDE):
            rows = _extended(rows, salted, key, on, simple)
            lengths.append(rows)
        level = materialize(reduce(DataFrame.unionByName, lengths), "path-rows")
        length += STRIDE
        counted = _counted(level, key).filter("support >= needed")
        found.append(counted)
        longest = level.filter(F.size("tool_sequence") == length)
        if longest.isEmpty():
            break
        rows = longest.join(_spread(counted.select(key, "tool_sequence")), [key, "tool_sequence", "salt"], "left_semi")
    return reduce(DataFrame.unionByName, found).selectExpr(
        key, "tool_sequence", *[f"if(same_n is not null, same_{c}, near_{c}) AS {c}" for c in TOTALS])


def measured(totals: DataFrame, key: str) -> DataFrame:
    """Means of a path over the runs that count; without any zeros, and its own length as avg_steps."""
    n = F.col("n")
    return totals.select(
        key, "tool_sequence",
        F.coalesce(F.round(F.col("sum_ms").cast("double") / n, 6), F.lit(0.0)).alias("avg_duration_ms"),
        F.coalesce(F.round(F.col("sum_cost").cast("double") / n, 9), F.lit(0.0)).alias("avg_cost_usd"),
        F.coalesce(F.col("sum_steps") / n, F.size("tool_sequence").cast("double")).alias("avg_steps"),
        F.coalesce(F.col("n_success") / n, F.lit(0.0)).alias("success_rate"),
        F.coalesce(n, F.lit(0)).alias("execution_count"),
    )


def path_metrics(
    groups: DataFrame, paths: DataFrame, key: str = "task_cluster"
) -> DataFrame:
    """Metrics of each given path over the runs that follow it.

    ``groups`` are variants.  Runs with exactly the path count; only if there are
    none, runs that contain it as a subsequence and are at most twice as long.
    Unmatched paths get zeros and their own length as avg_steps.
    """
    given = materialize(paths.select(key, "tool_sequence"), "given-paths")
    steps = (
        given.select(key, "tool_sequence", F.explode(F.sequence(F.lit(1), F.size("tool_sequence"))).alias("i"))
        .select(key, F.expr("slice(tool_sequence, 1, i - 1)").alias("tool_sequence"), F.expr("tool_sequence[i - 1]").alias("tool"))
        .groupBy(key, "tool_sequence").agg(F.collect_set("tool").alias("next"))
    )
    clusters = given.select(key).distinct().withColumn("needed", F.lit(1))
    grown = grown_paths(materialize(_dealt(groups), "path-variants"), materialize(steps, "path-steps"), clusters, key,
                        "tool_sequence", simple=False)
    return measured(given.join(grown, [key, "tool_sequence"], "left"), key)


def supported_paths(
    metrics: DataFrame, sizes: DataFrame, min_success_rate: float, key: str = "task_cluster",
    share: float = 0.10,
) -> DataFrame:
    """Paths reliable enough and followed by at least 2 runs and a share of the cluster."""
    support = F.greatest(F.lit(2), F.floor(F.col("n_traces") * share))
    return (
        metrics.filter(F.col("success_rate") >= min_success_rate)
        .join(sizes.select(key, "n_traces"), key)
        .filter(F.col("execution_count") >= support)
        .drop("n_traces")
    )


def _dominated(key: str) -> Column:
    """Row a is no better than row b anywhere and worse somewhere."""
    at_least = lambda c: F.col(f"b.{c}") <= F.col(f"a.{c}")
    less = lambda c: F.col(f"b.{c}") < F.col(f"a.{c}")
    return (
        (F.col(f"a.{key}") == F.col(f"b.{key}"))
        & at_least("avg_duration_ms") & at_least("avg_cost_usd")
        & (F.col("b.success_rate") >= F.col("a.success_rate"))
        & (less("avg_duration_ms") | less("avg_cost_usd")
           | (F.col("b.success_rate") > F.col("a.success_rate")))
    )


def pareto_front(candidates: DataFrame, key: str = "task_cluster", block_rows: int = FRONT_BLOCK) -> DataFrame:
    """Paths not dominated in (duration, cost, failure rate), all minimised; equal
    points are all kept.

    Two phases: every block of a cluster keeps its own front, and the survivors of
    different blocks are compared block by block.  A dominated point is dominated by
    one that survives its block, so survivors need no other partners.
    """
    def cut(rows: DataFrame) -> tuple[DataFrame, int]:
        blocks = -(-rows.count() // block_rows) or 1
        return rows.withColumn("_block", F.pmod(F.xxhash64("tool_sequence"), F.lit(blocks)).cast("int")), blocks

    rows, blocks = cut(materialize(candidates, "front-points"))
    same_block = F.col("a._block") == F.col("b._block")
    survivors = rows.alias("a").join(rows.alias("b"), same_block & _dominated(key), "left_anti").drop("_block")
    if blocks == 1:
        return survivors
    rows, blocks = cut(materialize(survivors, "front-survivors"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    ones = rows.withColumn("_other", every).alias("a")
    others = rows.withColumn("_other", F.col("_block")).drop("_block").withColumn("_block", every).alias("b")
    pair = same_block & (F.col("a._other") == F.col("b._other"))
    beaten = ones.join(others, pair & _dominated(key), "left_semi").select(key, "tool_sequence").distinct()
    return rows.drop("_block").join(beaten, [key, "tool_sequence"], "left_anti")


def scored_front(front: DataFrame, key: str = "task_cluster") -> DataFrame:
    """Front with the sum of min-max normalised objectives and a rank from 0.

    Rank 0 is the knee point; ties go to the smallest sequence.  The reference ranks
    in order of enumeration, which has no meaning here.
    """
    everything = Window.partitionBy(key)

    def scaled(value: Column) -> Column:
        low, high = F.min(value).over(everything), F.max(value).over(everything)
        return F.coalesce((value - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0))

    score = (
        scaled(F.col("avg_duration_ms")) + scaled(F.col("avg_cost_usd"))
        + scaled(1 - F.col("success_rate"))
    )
    order = Window.partitionBy(key).orderBy(F.round("score", 9), "tool_sequence")
    return front.withColumn("score", score).withColumn("pareto_rank", F.row_number().over(order) - 1)


def has_long_path(following: dict[str, list[str]], least: int) -> tuple[bool, bool]:
    """Is there a path from start to end, and one of at least ``least`` different tools?

    Depth first over (last tool, tools used).  A state is given up when the end, or enough
    further tools, cannot be reached past the used ones.
    """
    def reach(node: str, used: frozenset) -> set[str]:
        seen, todo = set(), [node]
        while todo:
            new = [n for n in following.get(todo.pop(), ()) if n not in used and n not in seen]
            seen.update(new)
            todo += [n for n in new if n != END_NODE]
        return seen

    firsts = [n for n in following.get(START_NODE, ()) if n != END_NODE]
    any_path = any(END_NODE in reach(n, frozenset([n])) for n in firsts)
    open_states, known = [(n, frozenset([n])) for n in firsts], set()
    while open_states:
        state = open_states.pop()
        if state in known:
            continue
        known.add(state)
        node, used = state
        if len(used) >= least and END_NODE in following.get(node, ()):
            return any_path, True
        ahead = reach(node, used)
        if END_NODE in ahead and len(used) + len(ahead) - 1 >= least:
            open_states += [(n, used | {n}) for n in following.get(node, ()) if n != END_NODE and n not in used]
    return any_path, False


def path_existence(edges: DataFrame, sizes: DataFrame, key: str = "task_cluster") -> DataFrame:
    """(key, any_path, any_long): has a cluster's graph a path, and one that covers the mean run?

    Works on graphs, at most one row per pair of tools, not on runs.
    """
    def decide(name: tuple, graph: pd.DataFrame) -> pd.DataFrame:
        following = graph.groupby("source")["target"].apply(list).to_dict()
        found = has_long_path(following, int(graph["covering"].iloc[0]))
        return pd.DataFrame({key: [name[0]], "any_path": [found[0]], "any_long": [found[1]]})

    wanted = edges.join(sizes.select(key, covering_length(F.col("avg_length")).alias("covering")), key)
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few rows, but much work on each
    return wanted.select(key, "source", "target", "covering").repartition(tasks, key).groupBy(key).applyInPandas(
        decide, f"{key} string, any_path boolean, any_long boolean")


def find_pareto_paths(
    edges: DataFrame, traces: DataFrame, key: str = "task_cluster", min_success_rate: float = 0.85,
    support_share: float = 0.10,
) -> DataFrame:
    """Search from edges and traces to the ranked Pareto front of every cluster.

    Only paths that enough runs contain are built.  Whether a cluster has a covering path
    at all, so that its shorter ones do not count, is mostly known from these; where it is
    not, its graph is asked, which may have such a path that no run follows.
    """
    reliable = materialize(keep_reliable_edges(edges, min_success_rate).select(key, "source", "target"), "path-edges")
    groups = materialize(_dealt(variants(traces, key)), "path-variants")
    sizes = materialize(variant_sizes(groups, key), "group-sizes")
    needed = sizes.select(key, F.greatest(F.lit(2), F.floor(F.col("n_traces") * support_share)).cast("long").alias("needed"))
    steps = reliable.filter(F.col("target") != END_NODE).groupBy(key, F.col("source").alias("last")).agg(
        F.collect_set("target").alias("next"))
    closing = reliable.filter(F.col("target") == END_NODE).select(key, F.col("source").alias("last"))
    complete = materialize(
        grown_paths(groups, steps, needed, key, "last")
        .withColumn("last", F.element_at("tool_sequence", -1)).join(closing, [key, "last"], "left_semi")
        .join(sizes, key)
        .select(key, "tool_sequence", *TOTALS,
                (F.size("tool_sequence") >= covering_length(F.col("avg_length"))).alias("long")),
        "complete-paths")
    columns = [key, "tool_sequence", *TOTALS]
    totals = complete.filter("long").select(*columns)
    undecided = sizes.join(totals.select(key).distinct(), key, "left_anti")
    if not undecided.isEmpty():
        asked = materialize(path_existence(reliable, undecided, key), "path-existence")
        short = complete.join(asked.filter("any_path and not any_long"), key, "left_semi").select(*columns)
        without = undecided.join(asked.filter("any_path"), key, "left_anti")
        frequent = groups.filter(F.size("tool_sequence") > 0).join(without, key, "left_semi").groupBy(key).agg(
            F.min_by(F.struct("tool_sequence", *TOTALS), F.struct(-F.col("n"), F.col("tool_sequence"))).alias("v"))
        totals = totals.unionByName(short).unionByName(frequent.select(key, "v.*"))
    supported = supported_paths(measured(totals, key), sizes, min_success_rate, key, support_share)
    return scored_front(pareto_front(supported, key), key)


def knee_points(front: DataFrame) -> DataFrame:
    """The best trade-off per cluster."""
    return front.filter(F.col("pareto_rank") == 0)
