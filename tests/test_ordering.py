"""Skew-proof neighbour, rank and rolling operators against plain computations."""

import random

import pytest
from pyspark.sql import functions as F

from trailmetrics.operators.anomalies import loop_steps
from trailmetrics.operators.ordering import (
    running_total, step_block, trailing_mean, with_borrowed_rows, with_next,
)
from trailmetrics.sources.driver_tables import number_steps


@pytest.mark.parametrize("direction", ["next", "previous"])
def test_neighbours_over_block_edges(spark, direction):
    rng = random.Random(5)
    steps = {"a": sorted(rng.sample(range(60), 25)), "b": [3], "c": [9, 10, 55]}
    rows = [(k, s, f"{k}{s}") for k, v in steps.items() for s in v]
    df = spark.createDataFrame(rows, "k string, s int, v string")
    got = with_next(df, ["k"], F.floor(F.col("s") / 5), ["s"], ["v"], direction)
    at = {(r["k"], r["s"]): r[direction] and r[direction]["v"] for r in got.collect()}
    for k, v in steps.items():
        for i, s in enumerate(v):
            j = i + 1 if direction == "next" else i - 1
            want = f"{k}{v[j]}" if 0 <= j < len(v) else None
            assert at[k, s] == want


def test_running_total_and_trailing_mean(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 4 else "cold", i, float(rng.randrange(100))) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i int, v double")
    totals = {(r["k"], r["i"]): r["t"] for r in running_total(df, ["k"], ["i"], "v", "t").collect()}
    means = {(r["k"], r["i"]): r["m"] for r in trailing_mean(df, ["k"], ["i"], "v", 3, "m").collect()}
    for key in ("hot", "cold"):
        own = [r for r in rows if r[0] == key]
        for n, (k, i, _) in enumerate(own):
            assert totals[k, i] == sum(r[2] for r in own[:n])
            last = [r[2] for r in own[max(0, n - 2): n + 1]]
            assert means[k, i] == pytest.approx(sum(last) / len(last))
    assert len(means) == len(rows)


def test_borrowed_rows_skip_short_blocks(spark):
    rows = [("a", 0, 1), ("a", 1, 2), ("a", 2, 3), ("a", 2, 4), ("b", 0, 1)]
    df = spark.createDataFrame(rows, "k string, b int, s int")
    got = with_borrowed_rows(df, ["k"], "b", ["s"], ["s"], 4)
    lent = sorted((r["k"], r["b"], r["s"]) for r in got.collect() if not r["own"])
    assert lent == [("a", 1, 1), ("a", 2, 1), ("a", 2, 2)]


def test_loop_steps_cross_blocks(spark):
    rows = [("w", s, f"e{s}", "x" if s >= 4094 else f"t{s}") for s in range(4090, 4099)]
    df = spark.createDataFrame(rows, "workflow_id string, step_number int, event_id string, tool_name string")
    df = df.withColumn("timestamp", F.lit("2024-01-01").cast("timestamp_ntz"))
    assert sorted(r["step_number"] for r in loop_steps(df).collect()) == [4097, 4098]


def test_step_numbers(spark):
    rows = [("u", f"2024-01-01 {h:02d}:{m:02d}:{s:02d}", h * 3600 + m * 60 + s) for h, m, s in
            [(0, 0, 1), (0, 0, 5), (0, 1, 0), (5, 0, 0), (23, 59, 59)]]
    df = spark.createDataFrame(rows, "workflow_id string, t string, source_id int").withColumn(
        "ts", F.col("t").cast("timestamp_ntz"))
    got = sorted((r["source_id"], r["step_number"]) for r in number_steps(df).collect())
    assert [n for _, n in got] == [1, 2, 3, 4, 5]


def test_neighbours_without_a_place_or_key(spark):
    rows = spark.createDataFrame(
        [("w", None, "b"), ("w", 1, "c"), ("w", 5000, "d"), (None, 1, "x"), (None, 9000, "y"), ("v", -1, "p"), ("v", None, "o")],
        "workflow_id string, step_number int, tool string")
    got = with_next(rows, ["workflow_id"], step_block(), ["step_number"], ["tool"])
    after = {r["tool"]: r["next"] and r["next"]["tool"] for r in got.collect()}
    assert after == {"b": "c", "c": "d", "d": None, "x": "y", "y": None, "o": "p", "p": None}


@pytest.mark.parametrize("direction", ["next", "previous"])
def test_neighbours_without_keys_or_blocks_and_without_a_join(spark, direction):
    """Null keys and blocks are keys and blocks of their own; rows are dealt to their blocks once."""
    rows = [(None, None, 1), (None, 0, 2), (None, 3, 7), ("a", None, 1), ("a", 2, 5), ("a", 2, 6), ("b", 4, 9)]
    df = spark.createDataFrame(rows, "k string, b int, s int").repartition(3)
    found = with_next(df, ["k"], F.col("b"), ["s"], ["s"], direction)
    assert found.columns == ["k", "b", "s", direction]
    pairs = {(None, 1): 2, (None, 2): 7, ("a", 1): 5, ("a", 5): 6}
    if direction == "previous":
        pairs = {(k, later): s for (k, s), later in pairs.items()}
    assert {(r["k"], r["s"]): r[direction] and r[direction]["s"] for r in found.collect()} == {
        (k, s): pairs.get((k, s)) for k, _, s in rows}
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
