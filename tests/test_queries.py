"""Known answers of dashboards, cluster queries, guidance and rules."""

import random
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import event, log, run
from trailmetrics.functions import measures, sequences, text, vectors
from trailmetrics.operators import edit_distance, matching, reports, rules, similarity
from trailmetrics.operators.significance import mode_significance
from trailmetrics.plans import clusters, dashboards, guidance


def value(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0]["v"]


def many(spark, columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).collect()[0])


def test_formats(spark):
    lit = F.lit
    null = F.lit(None).cast("double")
    assert many(spark, [
        text.format_duration(lit(999.0)), text.format_duration(lit(1000.0)), text.format_duration(null),
        text.format_cost(lit(0.005)), text.format_cost(lit(0.05)), text.format_cost(null),
        text.format_percent(lit(0.125)), text.format_count(lit(1234567.0)), text.format_count(lit(2.25)),
        measures.delta_label(lit(0.0), lit(5.0)), measures.delta_label(lit(100.0), lit(60.0)),
        measures.delta_label(lit(100.0), lit(150.0)), measures.percent_improvement(lit(0.0), lit(3.0)),
    ]) == ["999ms", "1.0s", "-", "$0.0050", "$0.05", "-", "12.5%", "1,234,567", "2.3", "-", "↓40%", "↑50%", 0.0]


def test_names(spark):
    lit = F.lit
    assert many(spark, [
        text.humanise(lit("check_ORDER_status")), text.title_case(lit("get_order")),
        text.parent_group(lit("Refunds (subcluster_3)")), text.parent_group(lit("Refunds")),
        text.variant_label(lit("Refunds (subcluster_3)")), text.variant_label(lit("Refunds")),
        text.variant_display_name(lit("Refunds (subcluster_0)"), lit("My task")),
        text.truncate(lit("x" * 61), 60, "…"), text.truncate(lit("abc"), 60, "…"),
    ]) == ["Check order status", "Get Order", "Refunds", "Refunds", "Variant 4", "Refunds", "My task", "x" * 60 + "…", "abc"]


def test_guidance_block(spark):
    def block(prompt):
        return value(spark, text.guidance_block(F.lit(prompt)))

    assert block("hello") is None
    assert block("a RECOMMENDED PATH: x \n\n--- y </context> z") == "RECOMMENDED PATH: x"
    assert block("RECOMMENDED PATH: 1\nOPTIMIZATION HINT: 2") == "OPTIMIZATION HINT: 2"  # priority, not place


def test_sequences(spark):
    def arr(s):
        return F.array(*[F.lit(c) for c in s]) if s else F.expr("cast(array() as array<string>)")

    assert many(spark, [
        sequences.is_subsequence(arr("ac"), arr("abc")), sequences.is_subsequence(arr("ca"), arr("abc")),
        sequences.is_subsequence(arr(""), arr("abc")), sequences.conformance_to_longest(arr("abd"), arr("abc")),
        sequences.conformance_to_longest(arr(""), arr("")),
        sequences.alignment(arr("axcd"), arr("abc")),
        sequences.collapse_repeats(arr("aabba")), sequences.same_tools_other_order(arr("ab"), arr("ba")),
        sequences.has_loop(arr("abaaxa"), 4), sequences.has_loop(arr("abaax"), 4),
    ]) == [True, False, True, pytest.approx(2 / 3), None, ["match", "deviation", "match", "extra"],
           list("aba"), True, True, False]


def test_edit_distance_of_tools(spark):
    book = F.array(*[F.lit(t) for t in ("get_order", "ship", "refund")])

    def code(*tools):
        return sequences.as_symbols(F.array(*[F.lit(t) for t in tools]), book)

    ab, abc = code("get_order", "ship"), code("get_order", "ship", "refund")
    assert many(spark, [F.levenshtein(ab, abc), sequences.normalised_edit_distance(ab, abc), F.length(abc)]) == [1, 0.4, 3]


def test_symbols_for_many_tools(spark):
    book = F.transform(F.sequence(F.lit(1), F.lit(70_000)), lambda i: F.concat(F.lit("t"), i))

    def code(*tools):
        return sequences.as_symbols(F.array(*[F.lit(t) for t in tools]), book)

    one, other = code("t1", "t6401", "t69999"), code("t1", "t8193", "t69999")
    assert many(spark, [F.levenshtein(one, other), F.length(one), F.levenshtein(one, one)]) == [1, 3, 0]


def test_cosine(spark):
    def sim(a, b):
        return vectors.cosine_similarity(F.lit(a).cast("array<double>"), F.lit(b).cast("array<double>"))

    assert many(spark, [sim([1.0, 0.0], [1.0, 1.0]), sim([0.0, 0.0], [1.0, 1.0]), sim([1.0], [1.0, 0.0])]) == [
        pytest.approx(0.5 ** 0.5), 0.0, 0.0]
    assert value(spark, vectors.parse_vector(F.lit("[0.1, 2]"))) == [0.1, 2.0]


def vector_table(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} string, embedding array<double>")


def test_centroid(spark):
    rows = [("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", None), ("b", [1.0, 2.0]), ("c", None)]
    got = {r["k"]: r["centroid"] for r in similarity.centroid(vector_table(spark, rows, "k"), "k").collect()}
    assert got == {"a": [0.5, 0.5], "b": [1.0, 2.0]}


@pytest.mark.parametrize("keep", ["all", "best_path", "best_workflow"])
@pytest.mark.parametrize("block_rows", [5, 2048])
def test_matching_against_brute_force(spark, keep, block_rows):
    rng = np.random.default_rng(4)
    vectors = {f"w{i:02d}": rng.normal(size=4) for i in range(30)} | {f"p{i:02d}": rng.normal(size=4) for i in range(12)}
    vectors["p12"] = vectors["p03"] * 2  # a tie
    table = {c: vector_table(spark, [(k, v.tolist()) for k, v in vectors.items() if k[0] == c], f"{n}_id")
             for c, n in (("w", "workflow"), ("p", "path"))}
    cosine = {
        (w, p): round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 9)
        for w, a in vectors.items() if w[0] == "w" for p, b in vectors.items() if p[0] == "p"}
    want = {pair: c for pair, c in cosine.items() if c >= 0.3}
    if keep != "all":
        side = 0 if keep == "best_path" else 1
        want = {
            pair: c for pair, c in want.items()
            if pair == min((q for q in want if q[side] == pair[side]), key=lambda q: (-want[q], q))}
    found = similarity.match_paths(table["w"], table["p"], 0.3, keep, block_rows)
    assert {(r["workflow_id"], r["path_id"]): round(r["similarity"], 9) for r in found.collect()} == want
    assert len(want) > 5


@pytest.mark.parametrize("block_rows", [1, 2048])
def test_paths_of_mixed_length(spark, block_rows):
    left = vector_table(spark, [("w1", [1.0, 0.0]), ("w2", [1.0]), ("w3", [1.0, 0.0, 0.0]), ("w4", None)], "workflow_id")
    right = vector_table(spark, [("p1", [2.0, 0.0]), ("p2", [3.0]), ("p3", None)], "path_id")
    found = similarity.match_paths(left, right, 0.5, block_rows=block_rows)
    assert sorted((r[0], r[1]) for r in found.collect()) == [("w1", "p1"), ("w2", "p2")]
    assert similarity.match_paths(left, right.limit(0), 0.5).count() == 0


@pytest.mark.parametrize("block_rows", [2, 1024])
@pytest.mark.parametrize("over", ["shortest", "longest"])
def test_best_paths_against_brute_force(spark, block_rows, over):
    known = ("ab", "abc", "xyz", "", "b")
    words = ("abc", "abd", "x", "ba", "cab", "")
    seqs = spark.createDataFrame([(list(s),) for s in words], "tool_sequence array<string>")
    paths = spark.createDataFrame([(i, list(p)) for i, p in enumerate(known)], "at bigint, tool_sequence array<string>")
    got = {"".join(r[0]): (r[1], r[2]) for r in matching.best_paths(seqs, paths, over, block_rows).collect()}
    length = min if over == "shortest" else max
    want = {}
    for word in filter(None, words):
        scores = [sum(x == y for x, y in zip(word, p)) / (length(len(word), len(p)) or 1) for p in known]
        want[word] = (scores.index(max(scores)), max(scores))
    assert got == want
    assert matching.best_paths(seqs, paths.limit(0), over, block_rows).count() == 0


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("limit", [0, 1, 2, 3])
def test_near_sequences_against_all_pairs(spark, limit):
    rng = np.random.default_rng(limit)
    words = {"".join(rng.choice(list("abcdé"), rng.integers(0, 9))) for _ in range(150)} | {"", "a", "aa", "aaaaaaaaaaaa", "aaaaaaaaaaab"}
    frame = spark.createDataFrame([(list(w),) for w in words] * 2, "tool_sequence array<string>")
    found = edit_distance.near_sequences(frame, limit).collect()
    got = {("".join(r["a"]), "".join(r["b"])): r["edits"] for r in found}
    assert len(got) == len(found)
    assert got == {(a, b): plain_edits(a, b) for a in words for b in words if a < b and plain_edits(a, b) <= limit}


def test_distances_to_paths(spark):
    runs = [(i, c, list(w)) for i, (c, w) in enumerate([("x", "abc"), ("x", ""), ("x", "abd"), ("y", "zz"), ("x", "abc"), ("none", "a")])]
    frame = spark.createDataFrame(runs, "workflow_id bigint, task_cluster string, tool_sequence array<string>")
    paths = spark.createDataFrame([("x", list("abd")), ("y", [])], "task_cluster string, tool_sequence array<string>")
    got = {r["workflow_id"]: (r["edits"], r["ned"]) for r in edit_distance.distances_to_paths(frame, paths).collect()}
    assert got == {0: (1, 2 / 6), 1: (3, 2.0), 2: (0, 0.0), 3: (2, 2.0), 4: (1, 2 / 6)}


# --- dashboards -------------------------------------------------------------------


def test_savings(spark):
    runs = [run(f"g{i}", "a", mode="guided", total_ms=1800.0) for i in range(20)] + [run(f"e{i}", "a", total_ms=3000.0) for i in range(3)]
    row = dashboards.savings(log(spark, *runs)).collect()[0]
    assert row["time_saved_ms"] == 24000.0 and row["pct_duration_improvement"] == 40.0 and row["guided_count"] == 20
    nothing = dashboards.savings(log(spark, run("g", "a", mode="guided"))).collect()[0]
    assert nothing["pct_duration_improvement"] == 0.0


def test_zero_means_stay_zero(spark):
    row = dashboards.analytics_summary(log(spark, run("w", "a", success=False, ms=0))).collect()[0]
    assert row["avg_duration_ms"] == 0.0 and row["success_rate"] == 0.0


def test_pages_and_active(spark):
    events = log(spark, run("a", "x"), run("b", "xy"), run("c", "x", end=False), [event("d", 1, "tool_call:x")])
    none = spark.createDataFrame([], "workflow_id string, task_description string")
    assert [r["workflow_id"] for r in dashboards.list_workflows(events, none, 1, 0).collect()] == ["b"]
    assert [r["workflow_id"] for r in dashboards.list_workflows(events, none, 5, 1).collect()] == ["a"]
    assert [r["workflow_id"] for r in dashboards.list_active_workflows(events, none).collect()] == ["c"]
    with pytest.raises(ValueError):
        dashboards.list_workflows(events, none, 501)


def test_mode_has_three_rules(spark):
    events = log(spark, [event("w", 0, "workflow:start", agent_role="Guided helper"), event("w", 1, "workflow:complete", duration_ms=5.0)])
    assert dashboards.mode_distribution(events).collect()[0]["exploration"] == 1
    assert reports.mode_by_role(events).collect()[0]["mode"] == "guided"


def test_round_summary_levels(spark):
    events = log(spark, run("a", "x", mode="guided"), run("b", "x"), run("c", "x", success=False))
    rows = reports.round_summary(events, F.lit("r1")).collect()
    total = [r for r in rows if r["round"] is None][0]
    assert (total["runs"], total["successes"], len(rows)) == (3, 2, 4)


def test_significance(spark):
    events = log(spark, *[run(f"g{i}", "a", mode="guided", total_ms=float(m)) for i, m in enumerate([1, 2, 2])],
                 *[run(f"e{i}", "a", total_ms=float(m)) for i, m in enumerate([2, 3, 4, 5])])
    row = mode_significance(events).collect()[0]
    assert row["mann_whitney_u"] == 1.0 and row["z"] < 0 and row["hedges_g"] < 0


def stored_paths(spark, *rows):
    ddl = ("path_id string, task_cluster string, tool_sequence array<string>, avg_duration_ms double, avg_steps double,"
           " success_rate double, execution_count bigint, embedding array<double>, guided_success_rate double,"
           " exploration_success_rate double, failure_warnings array<string>, alternative_paths array<struct<"
           "tool_sequence:array<string>,execution_count:bigint,success_rate:double,avg_steps:double>>,"
           " decision_tree struct<common_prefix:array<string>,branch_tool:string,condition_question:string,"
           "condition_key:string,branches:array<struct<path:array<string>,execution_count:bigint,success_rate:double,"
           "condition_value:string,label:string>>>, updated_at timestamp_ntz")
    full = []
    for r in rows:
        base = dict(path_id="p", task_cluster="c", tool_sequence=["a", "b"], avg_duration_ms=1.0, avg_steps=2.0,
                    success_rate=0.95, execution_count=40, embedding=[1.0, 0.0], guided_success_rate=None,
                    exploration_success_rate=None, failure_warnings=[], alternative_paths=[], decision_tree=None,
                    updated_at=datetime(2024, 1, 1))
        base.update(r)
        full.append(tuple(base.values()))
    return spark.createDataFrame(full, ddl)


def test_grouping(spark):
    paths = stored_paths(
        spark, {"path_id": "1", "task_cluster": "Refund Processing", "execution_count": 10},
        {"path_id": "2", "task_cluster": "Refund Processing (subcluster_0)", "execution_count": 6},
        {"path_id": "3", "task_cluster": "Refund Processing (subcluster_1)", "execution_count": 4})
    row = clusters.task_clusters_grouped(paths).collect()
    assert len(row) == 1 and row[0]["total_workflows"] == 10 and row[0]["members"] == 3
    assert clusters.group_path_ids(paths, "Refund Processing").count() == 3
    none = clusters.select_paths(paths, [])
    assert none.count() == 0


def test_conformance(spark):
    events = log(spark, run("w1", "abd"), run("w2", "axc"))
    vectors_of = vector_table(spark, [("w1", [1.0, 0.0]), ("w2", [1.0, 0.0])], "workflow_id")
    paths = stored_paths(spark, {"tool_sequence": list("abc")})
    got = clusters.average_conformance(events, vectors_of, paths, ["p"], 0.85).collect()[0]
    assert got["avg_conformance"] == pytest.approx(2 / 3)
    empty = clusters.average_conformance(events, vectors_of, paths, [], 0.85).collect()[0]
    assert empty["avg_conformance"] is None


@pytest.mark.parametrize("given,mode,reason", [
    ({"guided_success_rate": 0.60, "exploration_success_rate": 0.90}, "exploration", "regression_detected"),
    ({"guided_success_rate": 0.85, "exploration_success_rate": 0.90}, "guided", "guided"),
    ({"guided_success_rate": 0.10}, "guided", "guided"),
    ({"execution_count": 29}, "exploration", "no_matching_paths"),
    ({"success_rate": 0.5}, "exploration", "no_matching_paths"),
    ({"embedding": [0.0, 1.0]}, "exploration", "below_threshold"),
])
def test_guidance(spark, given, mode, reason):
    tasks = vector_table(spark, [("w", [1.0, 0.1])], "workflow_id")
    row = guidance.guidance(tasks, stored_paths(spark, given)).collect()[0]
    assert (row["mode"], row["reason"]) == (mode, reason)
    assert (row["path"] is None) == (mode == "exploration")


def test_guidance_without_embedding(spark):
    tasks = vector_table(spark, [("w", None)], "workflow_id")
    assert guidance.guidance(tasks, stored_paths(spark, {})).collect()[0]["reason"] == "embedding_failed"


def test_guidance_texts(spark):
    tasks = vector_table(spark, [("w", [1.0, 0.0])], "workflow_id")

    def render(**given):
        return guidance.guidance_text(guidance.guidance(tasks, stored_paths(spark, given))).collect()[0]["guidance_text"]

    single = render(failure_warnings=["mind the gap"])
    assert "  1. a\n  2. b\nBased on 40 runs (95% success rate)." in single
    assert "COMMON FAILURE PATTERNS:\n  - mind the gap" in single and single.endswith("do not retry the same call.")
    several = render(alternative_paths=[(["x"], 3, 0.5, 1.0)])
    assert "  Path A (primary, 40 runs, 95% success):\n    1. a\n    2. b" in several
    assert "  Path B (3 runs, 50% success):\n    1. x" in several
    branches = [(["c"], 5, 1.0, "in", "C"), ([], 2, 0.5, "out", "Direct completion")]
    tree = render(decision_tree=(["a"], "a", "Based on A result?", "status", branches))
    assert tree.startswith("OPTIMIZATION HINT — Suggested approach for this task type:\n\n  1. a\n     |\n     +-- Based on A result?")
    assert "     |   YES --> C (5 runs, 100% success):\n     |    2. c" in tree and "NO --> Direct completion (2 runs, 50% success):" in tree


# --- rules -------------------------------------------------------------------------


def test_wallet_charges(spark):
    wallets = spark.createDataFrame([(1, 100.0), (2, -5.0)], "customer_id bigint, balance double")
    rows = [(1, 1, 60.0), (2, 1, 50.0), (3, 1, 40.0), (4, 1, -10.0), (5, 1, 10.0), (6, 2, 1.0), (7, 2, -20.0), (8, 2, 15.0)]
    payments = spark.createDataFrame([(p, date(2024, 1, t), t, a) for t, p, a in rows], "payment_id bigint, created date, transaction_id bigint, amount double")
    got = {r["transaction_id"]: (r["status"], r["balance"]) for r in rules.wallet_ledger(payments, wallets).collect()}
    ok, no = "completed", "failed"
    assert got == {1: (ok, 40.0), 2: (no, 40.0), 3: (ok, 0.0), 4: (ok, 10.0), 5: (ok, 0.0), 6: (no, -5.0), 7: (ok, 15.0), 8: (ok, 0.0)}


def test_wallets_against_a_ledger_in_order(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2, 3]), date(2024, 1, 1 + rng.randrange(20)), t, rng.choice([None, -7.25, 3.1, 12.0, 40.55]))
            for t in range(600)]
    opening = {1: 50.0, 2: 1e6, 3: -3.0, 4: 8.0}
    left, wanted = {w: round(100 * b) for w, b in opening.items()}, {}
    for wallet, _, t, amount in sorted(rows, key=lambda r: (r[1], r[2])):
        due = round(100 * (amount or 0))
        paid = due <= 0 or left[wallet] >= due
        left[wallet] -= due if paid else 0
        wanted[t] = ("completed" if paid else "failed", left[wallet] / 100)
    payments = spark.createDataFrame(rows, "payment_id bigint, created date, transaction_id bigint, amount double")
    wallets = spark.createDataFrame(list(opening.items()), "customer_id bigint, balance double")
    got = rules.wallet_ledger(payments.repartition(4), wallets).collect()
    assert len(got) == len(rows) and {r["transaction_id"]: (r["status"], r["balance"]) for r in got} == wanted
    assert rules.wallet_ledger(payments.limit(0), wallets).collect() == []


def test_search_scores(spark):
    rows = [("k1", "Refund policy", ["refund", "money"], "how to refund"), ("k2", "Shipping", ["refunds"], "no"), ("k3", "Other", [], "x")]
    articles = spark.createDataFrame(rows, "article_id string, title string, keywords array<string>, content string")
    got = rules.keyword_search(articles, ["Refund", ""]).orderBy("position").collect()
    assert [(r["article_id"], r["score"]) for r in got] == [("k1", 4), ("k2", 1)]


def test_return_eligibility_asks_products_for_fulfilled_orders_only(spark):
    orders = spark.createDataFrame(
        [(1, 7, "fulfilled", 10, 5.0), (2, 7, "fulfilled", 31, 5.0), (3, 8, "fulfilled", 1, 5.0), (4, 7, "fulfilled", None, 5.0),
         (5, 7, "pending", 1, 5.0), (6, 8, "backordered", None, 5.0), (7, 7, None, 1, 5.0), (8, None, "fulfilled", 1, 5.0)],
        "order_id bigint, product_id bigint, status string, days_since int, total double")
    products = spark.createDataFrame([(7, 30), (9, 60)], "product_id bigint, return_window_days bigint")
    found = rules.return_eligibility(orders, products)
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == {
        1: (True, "within 30 days (10 since purchase)", 5.0), 2: (False, "window expired: 31 days, 30 allowed", None),
        3: (False, "product not found", None), 4: (False, "order date unknown", None),
        5: (False, "status is pending", None), 6: (True, "cancellable at any time", 0.0),
        7: (None, "within 30 days (1 since purchase)", None), 8: (False, "product not found", None)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Union") < plan.index("Join")  # the other orders go past the join
