"""The whole analysis run on small logs."""

from threading import Barrier

import pytest

from tests.helpers import log, run
from trailmetrics.operators import graphs
from trailmetrics.plans import analysis
from trailmetrics.plans.analysis import Settings, run_analysis
from trailmetrics.session import together

REFUND = ["check_ticket", "get_order", "check_refund_eligibility", "process_refund", "send_message", "close_ticket"]
DDL = "workflow_id string, task_description string, embedding array<double>"


def test_refund_cluster_with_variant(spark):
    runs = [run(f"w{i}", REFUND, ms=100.0 + 50 * i, mode="guided" if i % 2 else None) for i in range(5)]
    runs += [run(f"x{i}", ["check_ticket", "escalate"]) for i in range(2)]
    runs += [run("f", REFUND[:2], success=False)]
    events = log(spark, *runs)
    ids = [f"w{i}" for i in range(5)] + ["x0", "x1", "f"]
    vectors = spark.createDataFrame([(w, f"Refund order {w}", [1.0, 0.0]) for w in ids] + [("lone", "Other", [0.0, 1.0])], DDL)
    result = run_analysis(events, vectors, Settings(min_executions=3))
    row = result.optimal_paths.collect()
    assert len(row) == 1
    row = row[0]
    assert row["tool_sequence"] == REFUND and row["execution_count"] == 8 and row["success_rate"] == 1.0
    assert row["task_cluster"] == "Refund order f" and row["embedding"] == [1.0, 0.0]
    assert [a["tool_sequence"] for a in row["alternative_paths"]] == [["check_ticket", "escalate"]]
    assert row["decision_tree"]["branch_tool"] == "check_ticket"
    assert row["guided_success_rate"] == 1.0 and row["exploration_success_rate"] == 5 / 6
    whole = [r for r in result.pareto_paths.collect() if r["task_key"] == "cluster_0"]
    assert whole and all(r["success_rate"] == 1.0 for r in whole)
    assert result.quality.count() >= 1 and result.suggestions.count() >= 1


def test_nothing_to_analyse(spark):
    events = log(spark, run("w", "ab"))
    result = run_analysis(events, spark.createDataFrame([("w", "t", None)], DDL))
    assert result.optimal_paths.count() == 0 and result.pareto_paths.count() == 0
    failed = run_analysis(
        log(spark, *[run(f"w{i}", "ab", success=False) for i in range(3)]),
        spark.createDataFrame([(f"w{i}", "t", [1.0]) for i in range(3)], DDL), Settings(min_executions=1))
    assert failed.optimal_paths.count() == 0 and failed.graph.count() == 0 and failed.patterns.count() == 0


def test_runs_are_aligned_once_and_texts_stay_out_of_stored_members(spark, monkeypatch):
    stored = {}
    for module in (analysis, graphs):
        def keep(df, label, write=module.materialize):
            stored.setdefault(label, []).append(df.columns)
            return write(df, label)
        monkeypatch.setattr(module, "materialize", keep)
    runs = [run(f"w{i}", "abc") for i in range(5)] + [run("x", "acb", success=False)]
    vectors = spark.createDataFrame([(w, f"Task {w}", [1.0, 0.0]) for w in ["w0", "w1", "w2", "w3", "w4", "x"]], DDL)
    result = run_analysis(log(spark, *runs), vectors, Settings(min_executions=3))
    assert len(stored["model-distances"]) == 1  # quality and patterns share the alignments
    assert all("task_description" not in c for label in ("cluster-members", "task-traces") for c in stored[label])
    texts = {r["workflow_id"]: r["task_description"] for r in result.members.collect()}
    assert texts == {w: f"Task {w}" for w in ["w0", "w1", "w2", "w3", "w4", "x"]}
    assert {(r["workflow_id"], r["task_description"]) for r in result.traces.collect()} == set(texts.items())
    assert [r["evidence"]["workflow_id"] for r in result.patterns.filter(
        "pattern_type = 'conformance_deviation' and task_key = 'cluster_0'").collect()] == ["x"]


def test_steps_that_do_not_need_each_other_run_at_once(spark):
    both = Barrier(2, timeout=30)  # breaks if one step waits for the end of the other

    def rows(n):
        both.wait()
        return spark.range(n).count()

    assert together(lambda: rows(3), lambda: rows(4)) == [3, 4]
    with pytest.raises(ValueError):
        together(lambda: spark.range(2).count(), lambda: int("no number"))


def test_no_stored_table_holds_texts(spark, monkeypatch):
    """Descriptions may be whole documents: the run names its clusters without storing them again."""
    from trailmetrics.operators import clustering

    stored = {}
    for module in (analysis, graphs, clustering):
        def keep(df, label, write=module.materialize):
            stored[label] = df.columns
            return write(df, label)

        monkeypatch.setattr(module, "materialize", keep)
    events = log(spark, *[run(f"w{i}", "abc") for i in range(6)])
    vectors = spark.createDataFrame([(f"w{i}", f"{'Task ' * 20}{i}", [1.0, 0.0]) for i in range(6)], DDL)
    result = run_analysis(events, vectors, Settings(min_executions=3))
    assert [r["task_cluster"] for r in result.optimal_paths.collect()] == [("Task " * 20)[:60]]
    assert "clustered" in stored and not [label for label, columns in stored.items() if "task_description" in columns]
    assert {(r["workflow_id"], r["task_description"]) for r in result.members.collect()} == {
        (f"w{i}", f"{'Task ' * 20}{i}") for i in range(6)}
