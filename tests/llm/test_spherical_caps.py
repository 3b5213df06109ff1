import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmetrics.llm import spherical_caps as caps

DDL = "vec_id bigint, embedding array<double>, label int, group string, rep string, n int, `a.b` int"


def frame(spark, rows, ddl=DDL):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, "g", "r", 1, 2)
                                  for i, v, label in rows], ddl).repartition(3)


def valid(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)


def brute(rows, cosine=0.98):
    """(vec_id, n_links, component_id, kept) by comparing all pairs."""
    units = [np.array(v, float) / np.abs(np.array(v, float)).max() if valid(v) and label is not None else None for _, v, label in rows]
    units = [None if u is None else u / np.linalg.norm(u) for u in units]
    links = [[] for _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            if units[a] is not None and units[b] is not None and rows[a][2] == rows[b][2] and len(units[a]) == len(units[b]) \
                    and units[a] @ units[b] >= cosine:
                links[a].append(b)
                links[b].append(a)
    found, seen = [None] * len(rows), set()
    for a in range(len(rows)):
        if a not in seen:
            group, todo = {a}, [a]
            while todo:
                new = [x for x in links[todo.pop()] if x not in group]
                group |= set(new)
                todo += new
            seen |= group
            least = min((rows[x][0] for x in group if rows[x][0] is not None), default=None)
            for x in group:
                found[x] = (rows[x][0], len(links[x]), least, least is None or rows[x][0] == least)
    return sorted(map(str, found))


def result(df, **given):
    return sorted(str(tuple(r)) for r in caps.vector_components(df, **given).collect())


def clustered(rng, n, dimensions, spread, labels=3):
    centres = rng.standard_normal((max(2, n // 8), dimensions))
    return [(i, centres[rng.integers(len(centres))] + spread * rng.standard_normal(dimensions) * rng.random(), int(rng.integers(labels)))
            for i in range(n)]


@pytest.mark.parametrize("dimensions, spread, given", [
    (64, 0.2, {}), (64, 0.2, {"vectors_per_filter": 4, "block": 16}), (7, 0.15, {"miss": 0.0, "vectors_per_filter": 8, "block": 32}),
    (64, 0.22, {"miss": 0.0, "vectors_per_filter": 2}),
])
def test_all_pairs(spark, dimensions, spread, given):
    rows = clustered(np.random.default_rng(dimensions), 400, dimensions, spread)
    want = brute(rows)
    assert len({w.split(", ")[2] for w in want}) < len(rows)
    assert result(frame(spark, rows), **given) == want


def test_one_dense_cluster_over_many_blocks(spark):
    rng = np.random.default_rng(1)
    centre = rng.standard_normal(32)
    rows = [(i, centre + 0.05 * rng.standard_normal(32), 1) for i in range(300)] + [(500 + i, centre, 1) for i in range(200)]
    assert result(frame(spark, rows), block=20, vectors_per_filter=16) == brute(rows)


def test_awkward_rows(spark):
    v, far = [1.0, 2.0, 3.0], [3.0, -2.0, 1.0]
    rows = [
        (1, v, 0), (2, v, 0), (2, v, 0), (3, [2.0, 4.0, 6.0], 0), (4, v, 1), (5, v, None), (6, None, 0), (7, [], 0), (8, [0.0, 0.0, 0.0], 0),
        (9, [1.0, None, 3.0], 0), (10, [1.0, float("nan"), 3.0], 0), (11, [float("inf"), 2.0, 3.0], 0), (None, v, 0), (None, far, 2),
        (None, far, 2), (None, None, None), (12, [1e200, 2e200, 3e200], 0), (13, [1e-200, 2e-200, 3e-200], 0), (14, [-0.0, 5.0], 3),
        (15, [0.0, 5.0], 3), (16, [4.0], 4), (17, [9.0], 4), (18, [-4.0], 4), (19, [0.0, 5.0, 0.0], 3), (20, far, 0), (4, far, 0),
    ]
    assert result(frame(spark, rows)) == brute(rows)


def test_empty_table(spark):
    assert caps.vector_components(frame(spark, [])).collect() == []
    assert caps.vector_components(spark.createDataFrame([(1, None, None)], "vec_id long, embedding array<float>, label int")
                                  ).collect() == [(1, 0, 1, True)]


def test_list_decoding_finds_every_filter_of_a_cap():
    rng = np.random.default_rng(0)
    points = rng.standard_normal((50, 24))
    rotation, one, two = caps.geometry(24, 9)
    rotated = caps.unit_vectors(points) @ rotation
    filters = np.concatenate([np.repeat(one, 9, axis=0), np.tile(two, (9, 1))], axis=1)
    assert np.allclose(np.linalg.norm(filters, axis=1), 1) and np.allclose(rotation @ rotation.T, np.eye(24))
    cosine = rotated @ filters.T
    row, found, own, best = caps.decoded(rotated, one, two, 0.98, 0.6)
    assert np.allclose(best, cosine.max(axis=1)) and (cosine.argmax(axis=1)[row[own]] == found[own]).all() and own.sum() == 50
    want = {(i, f) for i, f in zip(*np.nonzero(cosine >= caps.cap(best, 0.98, 0.6)[:, None]))}
    assert set(zip(row.tolist(), found.tolist())) == want


def test_miss_bound():
    assert caps.least_coordinate(64, 0) == 1.0 and 0.6 < caps.least_coordinate(64, 1e-9) < 0.75
    rng = np.random.default_rng(2)
    y = rng.standard_normal((200_000, 63))
    y = y[:, 0] / np.linalg.norm(y, axis=1)
    z = caps.least_coordinate(64, 1e-3)
    assert 0.0002 < (y < -z).mean() < 0.0015


def test_heavy_classes_are_bounded(spark):
    result = spark.range(5).selectExpr("id digest_a", "id digest_b", "id + 1 as n", "id n_links", "id component_id", "true valid")
    rows = spark.range(50).select(F.col("id").alias("vec_id"), (F.col("id") % 7).alias("digest_a"), (F.col("id") % 7).alias("digest_b"))
    found = caps.with_class(rows, result).collect()
    assert len(found) == 50 and sum(r["valid"] is None for r in found) == sum(i % 7 > 4 for i in range(50))
