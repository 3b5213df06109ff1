"""Traces, graphs, anomalies, path search, warnings, trees and suggestions on small logs."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import log, members, run
from trailmetrics.operators import anomalies, decision_tree, failure_warnings, graphs, path_search, suggestions
from trailmetrics.operators.traces import build_traces, common_prefix_length, variants


def first(df):
    return df.collect()[0]


def test_trace_totals(spark):
    tools = ["check_ticket", "get_order", "check_refund_eligibility", "process_refund", "send_message", "close_ticket"]
    ms = [230, 140, 95, 320, 180, 150]
    done = log(spark, run("w", tools, ms=ms, total_ms=400.0), run("open", tools, ms=ms, end=False),
               run("bad", tools, success=False, ms=ms, total_ms=9999.0))
    rows = {r["workflow_id"]: r for r in build_traces(done).collect()}
    assert rows["w"]["tool_sequence"] == tools and rows["w"]["total_steps"] == 6
    assert rows["w"]["total_duration_ms"] == 400.0 and rows["w"]["success"]
    assert float(rows["w"]["total_cost_usd"]) == 0.006
    assert rows["open"]["total_duration_ms"] == 1115.0 and not rows["open"]["success"]
    assert rows["bad"]["total_duration_ms"] == 1115.0  # a failure's own duration is not used


def test_transitions(spark):
    got = graphs.transitions(log(spark, run("wf-1", "ab"), run("wf-2", "ba"), run("wf-3", "cc"))).collect()
    assert {(r["source"], r["target"]): r["weight"] for r in got} == {("a", "b"): 1, ("b", "a"): 1, ("c", "c"): 1}


def test_edges_use_last_call_of_target(spark):
    events = log(spark, run("w", "aba", ms=[10, 20, 50]), run("none", ""))
    edges = graphs.directly_follows_graph(events, members(spark, events))
    got = {(r["source"], r["target"]): (r["frequency"], r["avg_duration_ms"]) for r in edges.collect()}
    assert got == {
        ("__START__", "a"): (1, 50.0), ("a", "b"): (1, 20.0), ("b", "a"): (1, 50.0), ("a", "__END__"): (1, 0.0)}


def test_model_and_conformance(spark):
    events = log(spark, run("ok", "abc"), run("bad", "axc", success=False), run("cut", "ab", success=False))
    group = members(spark, events)
    model = graphs.process_model(events, group)
    assert {(r["source"], r["target"]) for r in model.collect()} == {
        ("__START__", "a"), ("a", "b"), ("b", "c"), ("c", "__END__")}
    quality = first(graphs.model_quality(events, group, model))
    assert quality["fitness"] == pytest.approx((1 + (1 - 2 / 6) + (1 - 1 / 5)) / 3)
    assert quality["precision"] == pytest.approx(1.0)
    left = {r["workflow_id"]: (r["missing"], r["remaining"]) for r in graphs.model_deviations(events, group, model).collect()}
    assert left == {"bad": (1, 1), "cut": (1, 0)}
    failed = log(spark, run("f", "ab", success=False))
    assert graphs.process_model(failed, members(spark, failed)).count() == 0


def best_alignment(seq, edges):
    """(cost, missing) by searching the product of run and model, cheapest first."""
    heap, done = [(0, 0, 0, graphs.START_NODE)], set()
    while heap:
        cost, missing, at, node = heapq.heappop(heap)
        if node == graphs.END_NODE:
            return cost, missing
        if (at, node) in done:
            continue
        done.add((at, node))
        if at < len(seq):
            heapq.heappush(heap, (cost + 1, missing, at + 1, node))
        for source, target in edges:
            if source == node:
                if target == graphs.END_NODE:
                    if at == len(seq):
                        heapq.heappush(heap, (cost, missing, at, target))
                else:
                    heapq.heappush(heap, (cost + 1, missing + 1, at, target))
                    if at < len(seq) and seq[at] == target:
                        heapq.heappush(heap, (cost, missing, at + 1, target))
    return None


def test_alignments_agree_with_a_search_of_the_product(spark):
    rng = np.random.default_rng(3)
    tools = list("abcdef")
    for trial in range(3):
        edges = [(graphs.START_NODE, "a"), ("a", "b"), ("b", graphs.END_NODE)] + [
            (s, t) for s in tools for t in [*tools, graphs.END_NODE] if rng.random() < 0.12 * (trial + 1)]
        model = spark.createDataFrame([("c", s, t) for s, t in set(edges)], "task_cluster string, source string, target string")
        runs = {tuple(rng.choice(tools, rng.integers(1, 12)).tolist()) for _ in range(80)}
        variants_ = spark.createDataFrame([("c", list(r)) for r in runs] + [("no model", ["a"])], "task_cluster string, tool_sequence array<string>")
        rows = graphs.alignments(variants_, model).collect()
        assert len(rows) == len(runs)
        for r in rows:
            assert (r["cost"], r["missing"]) == best_alignment(r["tool_sequence"], edges)
            assert r["worst"] == len(r["tool_sequence"]) + best_alignment([], edges)[0]


def kinds(df):
    return [(r["tool_name"], r["evidence"]) for r in df.collect()]


def test_redundant_steps(spark):
    events = log(spark, run("w1", "aba"), run("w2", "aa"), run("w3", "aaa"))
    assert kinds(anomalies.redundant_steps(events, members(spark, events))) == [("a", {"count": "2", "workflow_id": "w1"})]


def test_retry_loops(spark):
    events = log(spark, run("w", "aab", statuses={1: "failure"}), run("x", "aab"), run("y", "ab", statuses={1: "failure"}))
    assert kinds(anomalies.retry_loops(events, members(spark, events))) == [
        ("a", {"failure_step": "1", "retry_step": "2", "workflow_id": "w"})]


def test_bottlenecks(spark):
    events = log(spark, run("w", "ab", ms=[900, 100]))
    found = kinds(anomalies.bottleneck_tools(events, members(spark, events)))
    assert [t for t, _ in found] == ["a"] and found[0][1]["pct_of_total"] == "0.9"
    idle = log(spark, run("w", "ab", ms=0))
    assert anomalies.bottleneck_tools(idle, members(spark, idle)).count() == 0


def pareto(spark, *runs, **kw):
    events = log(spark, *runs)
    group = members(spark, events)
    edges = graphs.directly_follows_graph(events, group)
    return [r["tool_sequence"] for r in path_search.find_pareto_paths(edges, group, **kw).orderBy("pareto_rank").collect()]


def test_search_keeps_supported_paths(spark):
    assert pareto(spark, *[run(f"w{i}", "ab") for i in range(19)], run("z", "a")) == [["a", "b"]]
    assert pareto(spark, *[run(f"w{i}", "abcd") for i in range(9)], run("z", "a")) == [list("abcd")]
    assert pareto(spark, run("w", "ab")) == []
    assert pareto(spark, run("w1", "ab", ms=250), run("w2", "ab", ms=300)) == [["a", "b"]]
    assert pareto(spark, *[run(f"w{i}", "a", success=False) for i in range(3)]) == []


def test_search_falls_back_to_frequent_sequence(spark):
    events = log(spark, run("w1", "a"), run("w2", "a"))
    group = members(spark, events)
    weak = graphs.directly_follows_graph(events, group).withColumn("success_rate", F.lit(0.1))
    got = path_search.find_pareto_paths(weak, group, min_success_rate=0.99).collect()
    assert [r["tool_sequence"] for r in got] == [["a"]]


def test_search_counts_a_covering_path_longer_than_every_run(spark):
    events = log(spark, *[run(f"w{i}", "ab") for i in range(4)])
    group = members(spark, events)

    def chain(*nodes):
        rows = [("c", a, b, 1.0) for a, b in zip(nodes, nodes[1:])]
        return spark.createDataFrame(rows, "task_cluster string, source string, target string, success_rate double")

    far = chain(graphs.START_NODE, "a", "b", "x", "y", graphs.END_NODE)
    assert path_search.find_pareto_paths(far, group).collect() == []
    near = far.union(chain("b", graphs.END_NODE))
    assert [r["tool_sequence"] for r in path_search.find_pareto_paths(near, group).collect()] == [["a", "b"]]
    open_end = chain(graphs.START_NODE, "a", "b", "x", "y")
    assert [r["tool_sequence"] for r in path_search.find_pareto_paths(open_end, group).collect()] == [["a", "b"]]


def points(spark, rows):
    data = [("c", list(n), d, c, 1.0, s, 5) for n, d, c, s in rows]
    return spark.createDataFrame(
        data, "task_cluster string, tool_sequence array<string>, avg_duration_ms double, avg_cost_usd double,"
        " avg_steps double, success_rate double, execution_count bigint")


def test_pareto_and_knee(spark):
    def names(df):
        return sorted("".join(r["tool_sequence"]) for r in df.collect())

    assert names(path_search.pareto_front(points(spark, [("a", 100.0, 0.01, 1.0), ("b", 200.0, 0.02, 0.5)]))) == ["a"]
    assert names(path_search.pareto_front(points(spark, [("a", 100.0, 0.05, 0.9), ("b", 200.0, 0.01, 0.9)]))) == ["a", "b"]
    assert names(path_search.pareto_front(points(spark, [("a", 1.0, 1.0, 1.0), ("b", 1.0, 1.0, 1.0)]))) == ["a", "b"]
    front = points(spark, [("a", 50.0, 0.10, 0.8), ("b", 100.0, 0.05, 0.9), ("c", 200.0, 0.01, 1.0)])
    assert names(path_search.knee_points(path_search.scored_front(front))) == ["c"]


def test_pareto_front_in_blocks(spark):
    rng = np.random.default_rng(4)
    values = rng.integers(0, 12, (400, 3)) / 10.0
    rows = [("c" if i % 3 else "d", [str(i)], *v) for i, v in enumerate(values.tolist())]
    frame = spark.createDataFrame(
        rows, "task_cluster string, tool_sequence array<string>, avg_duration_ms double, avg_cost_usd double, success_rate double")
    want = sorted(
        a[1][0] for a in rows if not any(
            b[0] == a[0] and b[2] <= a[2] and b[3] <= a[3] and b[4] >= a[4] and b[2:] != a[2:] for b in rows))
    for block_rows in (16, 1000):
        found = path_search.pareto_front(frame, block_rows=block_rows)
        assert sorted(r["tool_sequence"][0] for r in found.collect()) == want


def test_pareto_front_of_many_points(spark):
    points = spark.range(100_000).select(
        F.lit("c").alias("task_cluster"), F.array(F.col("id").cast("string")).alias("tool_sequence"),
        (F.pmod(F.xxhash64("id"), F.lit(9973)) + 1.0).alias("avg_duration_ms"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(9967)) + 1.0).alias("avg_cost_usd"),
        (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(101)) / 100.0).alias("success_rate"))
    values = points.toPandas()
    cost = np.stack([values["avg_duration_ms"], values["avg_cost_usd"], -values["success_rate"]], axis=1)
    front = np.empty((0, 3))
    for point in cost[np.lexsort(cost.T[::-1])]:
        if not ((front <= point).all(axis=1) & (front < point).any(axis=1)).any():
            front = np.concatenate([front, point[None, :]])
    assert path_search.pareto_front(points).count() == len(front)


def test_search_agrees_with_enumeration(spark):
    rng = np.random.default_rng(9)
    tools = "abcdefg"
    runs = [run(f"w{i}", "".join(rng.choice(list(tools), rng.integers(1, 8))), success=bool(rng.random() < 0.8), ms=float(rng.integers(50, 900)))
            for i in range(120)]
    events = log(spark, *runs)
    group = members(spark, events)
    edges = graphs.directly_follows_graph(events, group).filter("frequency > 2").cache()
    sizes = path_search.group_sizes(group)
    for share in (0.0, 0.05):
        every = path_search.covering_paths(path_search.enumerate_paths(path_search.keep_reliable_edges(edges, 0.6), 20), sizes)
        metrics = path_search.path_metrics(variants(group, "task_cluster"), path_search.with_fallback(every, group))
        supported = path_search.supported_paths(metrics, sizes, 0.6, share=share)
        want = path_search.scored_front(path_search.pareto_front(supported)).collect()
        got = path_search.find_pareto_paths(edges, group, min_success_rate=0.6, support_share=share).collect()
        assert sorted(map(str, got)) == sorted(map(str, want)) and want


def test_long_paths_of_a_graph():
    start, end = graphs.START_NODE, graphs.END_NODE
    dense = {start: list("abcdefghijklmnopqrstuvwxyz"), **{a: [*(b for b in "abcdefghijklmnopqrstuvwxyz" if b != a), end]
                                                            for a in "abcdefghijklmnopqrstuvwxyz"}}
    assert path_search.has_long_path(dense, 26) == (True, True)
    line = {start: ["a"], "a": ["b", end], "b": ["a", "c"], "c": ["d"]}
    assert path_search.has_long_path(line, 1) == (True, True) and path_search.has_long_path(line, 2) == (True, False)
    assert path_search.has_long_path({start: ["a", end], "a": ["b"], "b": ["a"]}, 2) == (False, False)
    assert path_search.has_long_path({start: [end]}, 1) == (False, False)


def test_path_metrics_of_paths_that_repeat_a_tool(spark):
    events = log(spark, run("w1", "aba"), run("w2", "abca"), run("w3", "abxyzwva"))
    paths = spark.createDataFrame([("c", list(p)) for p in ("aa", "aba", "abca", "aab")], "task_cluster string, tool_sequence array<string>")
    got = {"".join(r["tool_sequence"]): r["execution_count"]
           for r in path_search.path_metrics(variants(members(spark, events), "task_cluster"), paths).collect()}
    assert got == {"aa": 2, "aba": 1, "abca": 1, "aab": 0}


def test_path_metrics_rules(spark):
    events = log(spark, run("w1", "abc"), run("w2", "axbxcxyz"), run("w3", "axb", success=False))
    paths = spark.createDataFrame([("c", list(p)) for p in ("abc", "ab", "zz")], "task_cluster string, tool_sequence array<string>")
    got = {"".join(r["tool_sequence"]): r for r in path_search.path_metrics(variants(members(spark, events), "task_cluster"), paths).collect()}
    assert got["abc"]["execution_count"] == 1  # exact match only
    assert got["ab"]["execution_count"] == 2 and got["ab"]["success_rate"] == 0.5  # abc and axb, not the long run
    assert got["zz"]["execution_count"] == 0 and got["zz"]["avg_steps"] == 2.0


def optimal(spark, tools, ms=0.0):
    return spark.createDataFrame([("c", list(tools), ms)], "task_cluster string, tool_sequence array<string>, avg_duration_ms double")


def warnings(spark, tools, *runs):
    events = log(spark, *runs)
    rows = failure_warnings.failure_warnings(events, members(spark, events), optimal(spark, tools)).collect()
    return rows[0]["failure_warnings"] if rows else []


def test_failure_warnings(spark):
    good = [run(f"g{i}", "abc") for i in range(5)]
    assert warnings(spark, "abc", *good, *[run(f"b{i}", "ab", success=False) for i in range(4)]) == [
        "c was missing in 4/4 failed runs but present in 5/5 successful runs"]
    many = [run(f"g{i}", "abcde") for i in range(5)] + [run(f"b{i}", "a", success=False) for i in range(5)]
    assert len(warnings(spark, "abcde", *many)) == 3
    assert warnings(spark, "abc", *good) == []
    west = [run(f"g{i}", ["route"], params={"route": {"warehouse": "west"}}) for i in range(4)]
    east = [run(f"b{i}", ["route"], success=False, params={"route": {"warehouse": "east"}}) for i in range(3)]
    assert warnings(spark, ["route"], *west, *east) == [
        "at route, successful runs used warehouse=west (4/4 runs) while failed runs used warehouse=east"]


def tree(spark, groups, responses=None):
    runs, place = [], []
    for sub, tools, n, success in groups:
        for i in range(n):
            runs.append(run(f"{sub}{i}", tools, success=success, responses=(responses or {}).get(sub)))
            place.append((f"{sub}{i}", sub))
    events = log(spark, *runs)
    subs = spark.createDataFrame(place, "workflow_id string, subcluster string")
    rows = decision_tree.decision_trees(events, members(spark, events).join(subs, "workflow_id")).collect()
    return rows[0]["decision_tree"] if rows else None


def test_decision_trees(spark):
    stock = {"s0": {"get_order": {"status": "in_stock", "id": 1}}, "s1": {"get_order": {"status": "backordered", "id": 1}}}
    got = tree(spark, [("s0", ["get_order", "fulfill", "ship"], 2, True), ("s1", ["get_order", "backorder", "notify"], 2, True)], stock)
    assert got["branch_tool"] == "get_order" and got["common_prefix"] == ["get_order"]
    assert got["condition_key"] == "status" and got["condition_question"] == "Based on Get order result?"
    assert [b["label"] for b in got["branches"]] == ["Ship", "Notify"]
    assert [b["condition_value"] for b in got["branches"]] == ["in_stock", "backordered"]
    sizes = tree(spark, [("s0", "abd", 2, True), ("s1", "abc", 5, True)])
    assert [b["execution_count"] for b in sizes["branches"]] == [5, 2]
    assert tree(spark, [("s0", "abc", 1, False), ("s1", "abd", 1, False)]) is None
    assert tree(spark, [("s0", "abc", 3, True)]) is None
    assert tree(spark, [("s0", "abc", 2, True), ("s1", "xyz", 2, True)]) is None


def test_discriminating_field_rules(spark):
    def best(a, b):
        rows = [("c", "s0", r) for r in a] + [("c", "s1", r) for r in b]
        df = spark.createDataFrame(rows, "task_cluster string, subcluster string, response map<string,string>")
        found = decision_tree.discriminating_fields(decision_tree.value_profiles(df)).collect()
        return found[0]["field"] if found else None

    assert best([{"status": "in"}] * 2, [{"status": "out"}] * 2) == "status"
    assert best([{"status": "in"}, {"status": "out"}], [{"status": "out"}] * 2) is None  # overlap
    assert best([{"name": "a"}, {"name": "b"}], [{"name": "c"}, {"name": "d"}]) is None  # all unique


def test_common_prefix(spark):
    rows = [("g", list(s)) for s in ("abx", "aby", "abz")] + [("h", list("ab")), ("h", list("abc")), ("i", list("q")), ("i", list("r"))]
    df = spark.createDataFrame(rows, "k string, tool_sequence array<string>")
    assert {r["k"]: r["prefix_length"] for r in common_prefix_length(df, "k").collect()} == {"g": 2, "h": 2, "i": 0}


def test_suggestions(spark):
    events = log(spark, run("w1", "ba", ms=[300, 100]), run("w2", "abx", ms=[1, 1, 7]), run("w3", "aab", ms=1))
    group = members(spark, events)
    patterns = anomalies.detect_patterns(events, group)
    rows = suggestions.generate_suggestions(events, group, optimal(spark, "ab", 150.0), patterns).collect()
    by_type = {}
    for r in rows:
        by_type.setdefault(r["suggestion_type"], []).append(r)
    assert by_type["reorder"][0]["estimated_saving_ms"] == 250.0
    assert "b → a" in by_type["reorder"][0]["message"]
    assert sorted(r["affected_tools"][0] for r in by_type["skip_step"]) == ["a", "x"]
    assert {r["priority"] for r in by_type["optimize_step"]} == {"medium"}


def test_json_null_is_a_parameter_value(spark):
    from pyspark.sql import functions as F

    from tests.helpers import log, members, run
    from trailmetrics.operators.failure_warnings import parameter_warnings

    events = log(
        spark, *[run(f"s{i}", "a", params={"a": {"p": None}}) for i in range(3)],
        *[run(f"f{i}", "a", success=False, params={"a": {"p": "x"}}) for i in range(3)])
    optimal = spark.createDataFrame([("c", ["a"])], "task_cluster string, tool_sequence array<string>")
    found = parameter_warnings(events, members(spark, events).withColumn("task_cluster", F.lit("c")), optimal).collect()
    assert len(found) == 1 and "null" in found[0]["warning"]


def test_distances_of_many_models_come_in_one_call_per_batch(spark):
    edges = [(f"m{i:03d}", s, t) for i in range(200) for s, t in [("a", "b"), ("b", "c"), ("c", "a"), ("c", f"x{i % 3}")][: 2 + i % 3]]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = graphs.model_distances(spark.createDataFrame(edges, "task_cluster string, source string, target string"))
        got = sorted(map(tuple, found.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for i in range(200):
        onward = {}
        for m, s, t in edges:
            if m == f"m{i:03d}":
                onward.setdefault(s, []).append(t)
        for start in onward:
            reach, ends, steps = {}, [start], 0
            while ends:
                steps, ends = steps + 1, [t for e in ends for t in onward.get(e, []) if t not in reach]
                reach.update({t: steps - 1 for t in ends})
            want += [(f"m{i:03d}", start, t, n) for t, n in reach.items()]
    assert got == sorted(want)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
