"""Clustering against a plain sequential algorithm on small inputs."""

import random

import numpy as np
import pytest

from trailmetrics.operators import clustering
from trailmetrics.operators.clustering import (
    cluster_by_embedding, cluster_names, cluster_sequences, cluster_vectors, edit_distances,
    subcluster_by_trace,
)


def plain_average_linkage(distance, cut):
    """Merge the closest two clusters until the closest are farther than the cut."""
    groups = [[i] for i in range(len(distance))]
    while len(groups) > 1:
        options = [
            (np.mean([distance[x][y] for x in a for y in b]), i, j)
            for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j
        ]
        d, i, j = min(options)
        if d > cut:
            break
        groups[i] = groups[i] + groups[j]
        del groups[j]
    return sorted(sorted(g) for g in groups)


def grouped(rows):
    out = {}
    for item, cluster in rows:
        out.setdefault(cluster, []).append(int(item))
    return sorted(sorted(g) for g in out.values())


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distances():
    rng = random.Random(1)
    seqs = [[rng.randrange(4) for _ in range(rng.randrange(7))] for _ in range(25)]
    got = edit_distances([np.array(s, dtype=int) for s in seqs], [np.array(s, dtype=int) for s in seqs])
    assert got.tolist() == [[plain_edits(a, b) for b in seqs] for a in seqs]


def test_edit_distances_of_long_sequences_and_many_codes():
    rng = random.Random(4)
    seqs = [[rng.randrange(-3, 900) for _ in range(n)] for n in (0, 1, 7, 40, 260, 300)]
    seqs += [seqs[-1][:-2] + [5, 6, 7], []]
    got = edit_distances([np.array(s, dtype="int32") for s in seqs], [np.array(s, dtype="int32") for s in seqs[::-1]])
    assert got.tolist() == [[plain_edits(a, b) for b in seqs[::-1]] for a in seqs]
    assert edit_distances([], []).shape == (0, 0)


@pytest.mark.parametrize("block_rows,cut", [(1000, 0.15), (1000, 0.45), (9, 0.3)])
def test_vectors_match_plain_algorithm(spark, block_rows, cut):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 5))
    points = [(centres[i % 4] + rng.normal(scale=0.6, size=5)).tolist() for i in range(24)]
    points += [points[0], points[1], points[1]]  # copies
    unit = np.array(points) / np.linalg.norm(points, axis=1, keepdims=True)
    want = plain_average_linkage(np.maximum(0, 1 - unit @ unit.T), cut)
    items = spark.createDataFrame([(f"{i:03d}", p) for i, p in enumerate(points)], "item string, embedding array<double>")
    got = cluster_vectors(items, cut, block_rows).collect()
    assert grouped((r["item"], r["cluster"]) for r in got) == want


@pytest.mark.parametrize("block_rows", [1000, 6])
def test_sequences_match_plain_algorithm(spark, block_rows):
    rng = random.Random(11)
    seqs = {tuple(rng.randrange(5) for _ in range(rng.randrange(1, 9))): rng.randrange(1, 4) for _ in range(22)}
    items = list(seqs.items())
    expanded = [i for i, (_, w) in enumerate(items) for _ in range(w)]
    ned = [[2 * plain_edits(items[a][0], items[b][0]) / (len(items[a][0]) + len(items[b][0])) for b in expanded] for a in expanded]
    cut = 0.553
    want = sorted({tuple(sorted({expanded[i] for i in g})) for g in plain_average_linkage(ned, cut)})
    rows = [("p", f"{i:03d}", w, list(s)) for i, (s, w) in enumerate(items)]
    df = spark.createDataFrame(rows, "part string, item string, weight bigint, codes array<int>")
    got = cluster_sequences(df, cut, block_rows).collect()
    assert [tuple(g) for g in grouped((r["item"], r["cluster"]) for r in got)] == want


def vectors(spark, rows):
    data = [(f"wf-{i}", f"task {i}", v) for i, v in enumerate(rows)]
    return spark.createDataFrame(data, "workflow_id string, task_description string, embedding array<double>")


def test_embedding_clusters(spark):
    same = cluster_by_embedding(vectors(spark, [[0.1] * 10] * 5), 0.9, 3).collect()
    assert len(same) == 5 and len({r["cluster_label"] for r in same}) == 1
    assert cluster_by_embedding(vectors(spark, [[0.1] * 3] * 2), 0.9, 3).count() == 0
    two = cluster_by_embedding(vectors(spark, [[1.0, 0.0, 0.0]] * 3 + [[0.0, 1.0, 0.0]] * 3), 0.9, 3).collect()
    assert sorted({r["cluster_label"] for r in two}) == ["cluster_0", "cluster_1"]
    assert cluster_by_embedding(vectors(spark, [[1.0, 0.0], None]), 0.9, 3).count() == 1
    assert cluster_by_embedding(vectors(spark, [None]), 0.9, 3).count() == 0
    mixed = cluster_by_embedding(vectors(spark, [[1.0, 0.0]] * 2 + [[1.0]] * 2), 0.9, 1).collect()
    assert len({r["cluster_label"] for r in mixed}) == 2


def test_zero_vectors_stay_apart(spark):
    items = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [0.0, 0.0])], "item string, embedding array<double>")
    assert {r["cluster"] for r in cluster_vectors(items, 0.5).collect()} == {"a", "b"}


def traces(spark, sequences):
    rows = [("c", f"wf-{i}", list(s)) for i, s in enumerate(sequences)]
    return spark.createDataFrame(rows, "cluster_label string, workflow_id string, tool_sequence array<string>")


def test_trace_subclusters(spark):
    def count(sequences, cut):
        return subcluster_by_trace(traces(spark, sequences), ned_threshold=cut).select("subcluster").distinct().count()

    assert count(["ab", "ab", "abc"], 0.5) == 1
    assert count(["ab", "xyz"], 0.5) == 2
    assert count(["abcdef"] * 10 + ["abcdefg"] * 5, 0.4) <= 2
    assert count(["", "", "ab"], 0.5) == 2


def test_names(spark):
    rows = [("c0", "a longer text"), ("c0", "short"), ("c1", None), ("c1", "  ")]
    got = cluster_names(spark.createDataFrame(rows, "cluster_label string, task_description string")).collect()
    assert {r["cluster_label"]: r["task_cluster"] for r in got} == {"c0": "short", "c1": "Unknown Cluster"}


def test_names_of_members_without_texts(spark):
    """The smallest of the shortest texts, whatever comes after its sixtieth character."""
    texts = [("a", "c0", "x" * 59 + "zb" + "q" * 40), ("b", "c0", "x" * 59 + "yc" + "q" * 40), ("c", "c0", "w" * 200),
             ("d", "c1", " "), ("e", "c2", None), ("f", "c2", "ok")]
    rows = spark.createDataFrame(texts, "workflow_id string, cluster_label string, task_description string")
    want = {"c0": "x" * 59 + "y", "c1": "Unknown Cluster", "c2": "ok"}
    short = clustering.short_descriptions(rows.drop("cluster_label"))
    assert not {"task_description"} & set(short.columns)
    for found in (cluster_names(rows), cluster_names(rows.drop("task_description"), short=short)):
        assert {r["cluster_label"]: r["task_cluster"] for r in found.collect()} == want


def recorded(monkeypatch):
    """(label, rows) of every table that clustering stores, in order."""
    seen, store = [], clustering.materialize

    def keep(df, label):
        table = store(df, label)
        seen.append((label, table.count()))
        return table

    monkeypatch.setattr(clustering, "materialize", keep)
    return seen


def test_sequence_rows_are_measured_once_and_shrink(spark, monkeypatch):
    """Two families and one stray: the stray leaves, merged rows are added up, nothing is measured again."""
    seqs = [[1] * 8 + [2] * i for i in range(1, 9)] + [[3] * 8 + [4] * i for i in range(1, 9)] + [[9, 8, 7]]
    rows = [("p", f"{i:03d}", 1, s) for i, s in enumerate(seqs)]
    df = spark.createDataFrame(rows, "part string, item string, weight bigint, codes array<int>")
    seen = recorded(monkeypatch)
    got = cluster_sequences(df, 0.4, block_rows=3).collect()
    ned = [[2 * plain_edits(a, b) / (len(a) + len(b)) for b in seqs] for a in seqs]
    assert grouped((r["item"], r["cluster"]) for r in got) == plain_average_linkage(ned, 0.4)
    sizes = [n for label, n in seen if label == "sequence-rows"]
    assert sizes[0] == len(seqs) and all(a > b for a, b in zip(sizes, sizes[1:])) and sizes[1] < len(seqs) - 1
    assert [label for label, _ in seen].count("sequence-state") == 1


def test_copies_of_vectors_follow_once(spark, monkeypatch):
    """Rounds store distinct vectors only, and those without a neighbour leave."""
    rng = np.random.default_rng(7)
    points = [(c + rng.normal(scale=0.3, size=4)).tolist() for c in np.eye(4)[:2] * 3 for _ in range(6)]
    points.append([0.0, 0.0, 0.0, -1.0])
    unit = np.array(points) / np.linalg.norm(points, axis=1, keepdims=True)
    copies = 20
    items = spark.createDataFrame(
        [(f"{i * copies + c:04d}", p) for i, p in enumerate(points) for c in range(copies)], "item string, embedding array<double>")
    seen = recorded(monkeypatch)
    got = cluster_vectors(items, 0.2, 2).collect()
    want = plain_average_linkage(np.maximum(0, 1 - unit @ unit.T), 0.2)
    assert grouped((r["item"], r["cluster"]) for r in got) == [[i * copies + c for i in g for c in range(copies)] for g in want]
    assert max(n for label, n in seen if label != "vector-nearest") == len(points)
    states = [n for label, n in seen if label == "vector-state"]
    assert states[1] < len(points) - 1


def test_separate_groups_of_vectors_need_no_rounds(spark, monkeypatch):
    """More vectors than a block holds, but no component of the links within the cut has more than one."""
    rng = np.random.default_rng(5)
    points = [(c + rng.normal(scale=0.3, size=4)).tolist() for c in np.eye(4) * 3 for _ in range(6)]
    unit = np.array(points) / np.linalg.norm(points, axis=1, keepdims=True)
    items = spark.createDataFrame([(f"{i:03d}", p) for i, p in enumerate(points)], "item string, embedding array<double>")
    seen = recorded(monkeypatch)
    got = cluster_vectors(items, 0.1, 7).collect()
    assert grouped((r["item"], r["cluster"]) for r in got) == plain_average_linkage(np.maximum(0, 1 - unit @ unit.T), 0.1)
    assert "vector-nearest" not in [label for label, _ in seen]


def test_sequences_around_one_need_few_rounds(spark, monkeypatch):
    """All variants are nearest to one sequence, which merged with one of them in each round."""
    base = list(range(1, 25))
    seqs = [base] + [base[:i] + [100 + i] + base[i + 1:] for i in range(23)]
    rows = [("p", f"{i:03d}", 1, s) for i, s in enumerate(seqs)]
    df = spark.createDataFrame(rows, "part string, item string, weight bigint, codes array<int>")
    seen = recorded(monkeypatch)
    got = cluster_sequences(df, 0.3, block_rows=12).collect()
    ned = [[2 * plain_edits(a, b) / (len(a) + len(b)) for b in seqs] for a in seqs]
    assert grouped((r["item"], r["cluster"]) for r in got) == plain_average_linkage(ned, 0.3)
    assert [label for label, _ in seen].count("sequence-rows") <= 6


def test_distances_of_sequences_are_not_stored(spark, monkeypatch):
    """What the rounds store grows with the sequences, not with their pairs; small tasks give the same clusters."""
    rng = random.Random(5)
    seqs = [list(s) for s in {tuple(rng.randrange(4) for _ in range(rng.randrange(2, 9))) for _ in range(60)}]
    rows = [("p", f"{i:03d}", 1 + i % 3, s) for i, s in enumerate(seqs)]
    df = spark.createDataFrame(rows, "part string, item string, weight bigint, codes array<int>")
    want = cluster_sequences(df, 0.5).collect()  # in one block
    monkeypatch.setattr(clustering, "CELLS", 256)
    monkeypatch.setattr(clustering, "PAIRS", 256)
    stored, store = [], clustering.materialize

    def keep(frame, label):
        stored.append((label, frame.schema.simpleString()))
        return store(frame, label)

    monkeypatch.setattr(clustering, "materialize", keep)
    got = cluster_sequences(df, 0.5, block_rows=7).collect()
    assert grouped((r["item"], r["cluster"]) for r in got) == grouped((r["item"], r["cluster"]) for r in want)
    assert "sequence-rows" in dict(stored) and not any("binary" in kinds for _, kinds in stored)


def test_copies_of_vectors_are_known_by_their_numbers(spark):
    """No vector becomes text; zero vectors and those without a number stay alone, signs of zero do not part copies."""
    rows = [("a", [1.0, 0.0]), ("b", [1.0, -0.0]), ("c", [1.0, 0.0]), ("d", [0.0, 0.0]), ("e", [0.0, 0.0]), ("f", [0.0, 1.0])]
    items = spark.createDataFrame(rows, "item string, embedding array<float>")
    found = cluster_vectors(items, 0.5)
    assert {r["item"]: r["cluster"] for r in found.collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "f": "f"}
    assert "sha2" not in found._jdf.queryExecution().optimizedPlan().toString()
