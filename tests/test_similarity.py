"""Links among the rows of one table."""

import numpy as np
import pytest

from trailmetrics.operators.similarity import similar_classes, similar_pairs


def test_copies_are_members_not_pairs(spark):
    vectors = [[1.0, 0.0]] * 50 + [[1.0, 0.1]] * 50 + [[0.0, 1.0], [0.0, 0.0], [0.0, 0.0], [float("nan"), 1.0], None]
    rows = spark.createDataFrame([(f"w{i:03d}", v) for i, v in enumerate(vectors)], "workflow_id string, embedding array<double>")
    found = similar_classes(rows, 0.95, block_rows=8).collect()
    assert [(r["workflow_id"], r["path_id"]) for r in found if r["relation"] == "link"] == [("w000", "w050")]
    home = {r["workflow_id"]: r["path_id"] for r in found if r["relation"] == "member"}
    assert len(found) == 105 and home == {
        f"w{i:03d}": "w000" if i < 50 else "w050" if i < 100 else f"w{i:03d}" for i in range(104)}


@pytest.mark.parametrize("member_rows", [3, 100])
def test_every_pair_of_runs_is_listed(spark, member_rows):
    """Copies of a vector and all copies of linked vectors, against all pairs in numpy."""
    rng = np.random.default_rng(2)
    different = [[1.0, 0.0, 0.0], [1.0, 0.1, 0.0], [1.0, 0.0, 0.3], *rng.normal(size=(6, 3)).tolist()]
    vectors = [different[i % len(different)] for i in range(70)] + [[0.0, 0.0, 0.0]] * 2
    unit = np.array([v / max(np.linalg.norm(v), 1e-300) for v in np.array(vectors)])
    cosine = unit @ unit.T
    want = {(f"w{i:03d}", f"w{j:03d}"): cosine[i, j] for i in range(72) for j in range(i + 1, 72) if cosine[i, j] >= 0.95}
    rows = spark.createDataFrame(
        [(f"w{i:03d}", v) for i, v in enumerate(vectors)] + [("w999", None)], "workflow_id string, embedding array<double>")
    found = similar_pairs(rows, 0.95, block_rows=8, member_rows=member_rows).collect()
    assert len(found) == len(want) and {(r["workflow_id"], r["path_id"]) for r in found} == set(want)
    assert all(abs(r["similarity"] - want[r["workflow_id"], r["path_id"]]) < 1e-9 for r in found)


def test_run_pairs_are_pairs(spark):
    """The registered query lists pairs of runs, not classes and their members."""
    import __spark_entry__ as entry

    found = entry.queries()["similar_run_pairs"](spark, "/root/testdata/sf0.01")
    assert found.columns == ["workflow_id", "path_id", "similarity"]
    assert found.filter("workflow_id >= path_id or similarity < 0.95").count() == 0 < found.count()
