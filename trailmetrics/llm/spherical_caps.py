"""Near-duplicate vectors by spherical-cap filters.

Filters are directions of a random product code behind a random rotation: a filter is one
code word for the first half of the dimensions and one for the second.  A vector names its
best filter and is list-decoded to all filters within its own cap; two vectors are compared
under the best filter of the one that lies closer to its filter.

The cap's radius makes the miss chance of a linked pair at most ``MISS``: for a vector whose
best filter lies at angle t, a partner at the threshold's angle has there the cosine
``c*cos(t) + s*sin(t)*y``, where y is a coordinate of a uniformly random direction, so a
quantile of its (beta) distribution bounds it.  ``miss=0`` takes y = -1, which misses nothing.
Filters grow with the number of vectors (``VECTORS_PER_FILTER``), postings with a small power
of it.

Equal vectors are merged before anything else and counted.  A posting carries a few rotated
coordinates in bytes; a pair whose distance there already exceeds the threshold's is no
candidate.  Only vectors with a candidate travel, once per filter in which they have one, and
are compared there in double precision.  A filter with many rows is cut into blocks whose
pairs are tasks of their own; these emit counts and one edge per row, never pairs.

A vector that is null, empty, zero or holds a null or non-finite component, or whose label is
null, links with nothing; vectors of different lengths have no cosine.  Rows without an id are
links like others; a component without any id has none and keeps its rows.  Rows that repeat
an id and a vector are copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmetrics.llm.common import map_batches, whole_groups
from trailmetrics.llm.near_dedup import components
from trailmetrics.session import materialize

MISS = 1e-9
VECTORS_PER_FILTER = 1024
BLOCK = 2048
SKETCH = 16  # rotated coordinates in a posting, one byte each
SALTS = 64
HEAVY_SHARE = 10_000
SLACK = 1e-5  # for single precision in a posting

# --- geometry -------------------------------------------------------------------------


def padded(dimensions: int) -> int:
    """Dimensions of the rotated space: even, and room for the sketch."""
    return max(dimensions + dimensions % 2, SKETCH)


@lru_cache(maxsize=8)
def geometry(dimensions: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotation, code of the first half, code of the second); filters have length 1."""
    n = padded(dimensions)
    rng = np.random.default_rng([13, n])
    q, r = np.linalg.qr(rng.standard_normal((n, n)))
    rotation = (q * np.sign(np.diag(r)))[:dimensions]
    codes = rng.standard_normal((2, words, n // 2))
    codes /= np.linalg.norm(codes, axis=2, keepdims=True) * np.sqrt(2)
    return rotation, codes[0], codes[1]


@lru_cache(maxsize=64)
def least_coordinate(dimensions: int, miss: float) -> float:
    """z with P(y < -z) <= miss for a coordinate y of a random direction orthogonal to a vector."""
    n = padded(dimensions) - 1
    if miss <= 0:
        return 1.0
    angle = np.linspace(0, np.pi, 200_001)  # y = -cos(angle), density sin^(n-2)
    density = np.sin(angle) ** (n - 2)
    chance = np.cumsum(density) / density.sum()
    return float(np.cos(angle[max(int(np.searchsorted(chance, miss)) - 1, 0)]))


def cap(best: np.ndarray, cosine: float, z: float) -> np.ndarray:
    """Least cosine that a partner of a vector with this best cosine has with that filter."""
    turned = cosine * best - np.sqrt(1 - cosine * cosine) * np.sqrt(np.maximum(1 - best * best, 0)) * z
    return np.minimum(turned, best) - SLACK


def unit_vectors(raw: np.ndarray) -> np.ndarray:
    raw = raw.astype(np.float64)
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def decoded(rotated: np.ndarray, one: np.ndarray, two: np.ndarray, cosine: float, z: float
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, filter, is it the row's best, best cosine of every row) for all filters within the rows' caps."""
    half = rotated.shape[1] // 2
    first, second = rotated[:, :half] @ one.T, rotated[:, half:] @ two.T
    best = first.max(axis=1) + second.max(axis=1)
    top = first.argmax(axis=1) * len(two) + second.argmax(axis=1)
    needed = cap(best, cosine, z)
    order = np.argsort(-second, axis=1)
    falling = -np.take_along_axis(second, order, axis=1)
    rows, filters = [], []
    for i in range(len(rotated)):
        # the second words that still reach the cap with each first word are a prefix of the order
        reach = np.searchsorted(falling[i], first[i] - needed[i], "right")
        words = np.flatnonzero(reach)
        n = reach[words]
        ahead = np.repeat(np.cumsum(n) - n, n)
        filters.append(np.repeat(words, n) * len(two) + order[i][np.arange(len(ahead)) - ahead])
        rows.append(np.full(len(ahead), i))
    row, found = np.concatenate(rows), np.concatenate(filters)
    return row, found, found == top[row], best


# --- classes of equal vectors ---------------------------------------------------------


def usable(embedding: Column, label: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(
        label.isNotNull() & F.forall(embedding, finite) & F.exists(embedding, lambda x: x != 0), F.lit(False))


def digested(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding (single precision stays) and a digest of 128 bits of both."""
    embedding = F.col("embedding")
    if dict(vectors.dtypes)["embedding"] != "array<float>":
        embedding = embedding.cast("array<double>")
    return vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), embedding.alias("embedding"),
        F.xxhash64(F.lit(1), F.col("label").cast("string"), embedding).alias("digest_a"),
        F.xxhash64(F.lit(2), F.col("label").cast("string"), embedding).alias("digest_b"),
    )


def vector_classes(rows: DataFrame) -> DataFrame:
    """One stored row per (label, vector): a number, its rows and its smallest id."""
    return materialize(
        rows.filter(usable(F.col("embedding"), F.col("label"))).groupBy("digest_a", "digest_b").agg(
            F.first("label").alias("label"), F.first("embedding").alias("embedding"),
            F.count("*").alias("n"), F.min("vec_id").alias("first_id"))
        .withColumn("rep", F.monotonically_increasing_id()),
        "caps-classes")


# --- postings and candidates ----------------------------------------------------------

CELL = ["group", "filter"]
POSTING = "group bigint, filter bigint, rep bigint, best float, own boolean, sketch_a bigint, sketch_b bigint"


def postings(classes: DataFrame, words: int, cosine: float, miss: float) -> DataFrame:
    """One row per vector and filter of its cap; ``group`` stands for label and length."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, rep = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            lists = batch.column(2)
            length = np.diff(lists.offsets.to_numpy())
            flat, start = lists.values.to_numpy(), lists.offsets.to_numpy()[:-1]
            for n in np.unique(length):
                mine = np.flatnonzero(length == n)
                rotation, one, two = geometry(int(n), words)
                z = least_coordinate(int(n), miss)
                room = max(1, (1 << 21) // words)
                for at in range(0, len(mine), room):
                    some = mine[at : at + room]
                    rotated = unit_vectors(flat[start[some][:, None] + np.arange(n)]) @ rotation
                    sketch = np.rint(rotated[:, :SKETCH] * 127).astype(np.int8).view(np.int64)
                    row, found, own, best = decoded(rotated, one, two, cosine, z)
                    who = some[row]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(group[who]), pa.array(found.astype(np.int64)), pa.array(rep[who]),
                        pa.array(best.astype(np.float32)[row]), pa.array(own), pa.array(sketch[row, 0]),
                        pa.array(sketch[row, 1])],
                        names=["group", "filter", "rep", "best", "own", "sketch_a", "sketch_b"])

    group = F.xxhash64("label", F.size("embedding")).alias("group")
    return map_batches(classes.select(group, "rep", "embedding"), work, POSTING)


def dealt(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows of a cell in pairs of blocks: ``own`` rows ask (one), all rows answer (two).

    ``sizes`` names the cells of more than one block.  Their rows take a salt into the join,
    so that a cell is no single key there.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int"))
    many = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    known = salted.join(many, [*CELL, "salt"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).drop("salt")
    mine = F.pmod(F.xxhash64("rep", F.lit(7)), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    ask = known.filter("own").withColumn("asks", F.lit(True)).withColumn("one", mine).withColumn("two", every)
    answer = known.withColumn("asks", F.lit(False)).withColumn("two", mine).withColumn("one", every)
    return ask.unionByName(answer).drop("blocks")


def in_blocks(rows: DataFrame) -> DataFrame:
    return rows.repartition(*CELL, "one", "two").sortWithinPartitions(*CELL, "one", "two")


def cell_sizes(rows: DataFrame, block: int) -> DataFrame:
    """Cells that need several blocks, stored."""
    counts = rows.groupBy(*CELL).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    return materialize(counts.filter("blocks > 1"), "caps-cells")


def asked_before(best: np.ndarray, rep: np.ndarray, asks: np.ndarray, answers: np.ndarray) -> np.ndarray:
    """Pairs that are compared here: the asking vector lies closer to its filter (ties: by number)."""
    mine, theirs = best[asks][:, None], best[answers][None, :]
    return (mine > theirs) | ((mine == theirs) & (rep[asks][:, None] > rep[answers][None, :]))


def block_pairs(rows: DataFrame, schema: str, compare) -> DataFrame:
    """``compare(table, asking rows, answering rows)`` gives the columns of a pair of blocks, or None."""
    names = [field.split()[0] for field in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, bounds in whole_groups(batches, [*CELL, "one", "two"]):
            asks = data.column("asks").to_numpy(zero_copy_only=False)
            for a, b in zip(bounds[:-1], bounds[1:]):
                ones, twos = np.flatnonzero(asks[a:b]), np.flatnonzero(~asks[a:b])
                if len(ones) and len(twos):
                    columns = compare(data.slice(a, b - a), ones, twos)
                    if columns is not None:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return map_batches(in_blocks(rows), work, schema)


def candidates(rows: DataFrame, cosine: float) -> DataFrame:
    """(cell, rep, best, own) of every vector that has a candidate there, whose other side is
    the cell's: vectors that ask, and vectors that answer."""
    coarse = 0.5 / 127 * np.sqrt(SKETCH)
    most = (127 * (np.sqrt(2 - 2 * cosine) + 2 * coarse)) ** 2 * (1 + 1e-6)

    def compare(data: pa.Table, ones: np.ndarray, twos: np.ndarray):
        rep, best = data.column("rep").to_numpy(), data.column("best").to_numpy()
        sketch = np.stack([data.column("sketch_a").to_numpy(), data.column("sketch_b").to_numpy()], axis=1)
        points = np.ascontiguousarray(sketch).view(np.int8).astype(np.float32)
        square = (points * points).sum(axis=1)
        ask, answer = np.zeros(data.num_rows, bool), np.zeros(data.num_rows, bool)
        for at in range(0, len(ones), 512):
            some = ones[at : at + 512]
            apart = square[some][:, None] + square[twos][None, :] - 2 * points[some] @ points[twos].T
            near = (apart <= most) & asked_before(best, rep, some, twos)
            ask[some] |= near.any(axis=1)
            answer[twos] |= near.any(axis=0)
        found = np.flatnonzero(ask | answer)
        if not len(found):
            return None
        cell = [np.full(len(found), data.column(c)[0].as_py()) for c in CELL]
        return [*cell, rep[found], best[found], ask[found]]

    return block_pairs(rows, "group bigint, filter bigint, rep bigint, best float, own boolean", compare)


def least_labels(linked: np.ndarray, names: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row and per column of a matrix of links the smallest name that it can reach."""
    far = np.iinfo(np.int64).max
    up, down = names.copy(), others.copy()
    while True:
        new_down = np.minimum(down, np.where(linked, up[:, None], far).min(axis=0))
        new_up = np.minimum(up, np.where(linked, new_down[None, :], far).min(axis=1))
        if (new_up == up).all() and (new_down == down).all():
            return up, down
        up, down = new_up, new_down


LINKS = "rep bigint, links bigint, root bigint"


def links(rows: DataFrame, cosine: float) -> DataFrame:
    """(rep, links, root) per vector and pair of blocks: how many rows it is linked with there,
    and the smallest number that it reaches there."""
    def compare(data: pa.Table, ones: np.ndarray, twos: np.ndarray):
        rep, best, n = (data.column(c).to_numpy() for c in ("rep", "best", "n"))
        vectors = data.column("embedding").combine_chunks()
        units = unit_vectors(vectors.values.to_numpy()[vectors.offsets[0].as_py() : vectors.offsets[-1].as_py()].reshape(data.num_rows, -1))
        linked = (units[ones] @ units[twos].T >= cosine) & asked_before(best, rep, ones, twos)
        if not linked.any():
            return None
        up, down = least_labels(linked, rep[ones], rep[twos])
        count = np.concatenate([linked @ n[twos], linked.T @ n[ones]])
        some = np.flatnonzero(count)
        return [np.concatenate([rep[ones], rep[twos]])[some], count[some], np.concatenate([up, down])[some]]

    return block_pairs(rows, LINKS, compare)


def linked_classes(
    classes: DataFrame, cosine: float, miss: float = MISS, vectors_per_filter: int = VECTORS_PER_FILTER, block: int = BLOCK
) -> DataFrame:
    """(rep, links, root), several rows per class, stored."""
    total = classes.count()
    words = max(2, int(np.ceil(np.sqrt(total / vectors_per_filter))))
    posted = postings(classes, words, cosine, miss)
    active = materialize(
        candidates(dealt(posted, cell_sizes(posted.select(*CELL), block)), cosine)
        .groupBy(*CELL, "rep", "best").agg(F.bool_or("own").alias("own")), "caps-active")
    wanted = dealt(active, cell_sizes(active, block)).join(classes.select("rep", "n", "embedding"), "rep")
    return materialize(links(wanted, cosine), "caps-links")


def vector_components(
    vectors: DataFrame, cosine: float = 0.98, miss: float = MISS, vectors_per_filter: int = VECTORS_PER_FILTER,
    block: int = BLOCK,
) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row per row of ``vectors``."""
    rows = digested(vectors)
    classes = vector_classes(rows)
    found = linked_classes(classes, cosine, miss, vectors_per_filter, block)
    label = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).select(
        F.col("node").alias("rep"), F.col("label").alias("root"))
    degree = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = classes.select("digest_a", "digest_b", "rep", "n", "first_id").join(label, "rep", "left").withColumn(
        "root", F.coalesce("root", "rep"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    result = materialize(
        named.join(least, "root").join(degree, "rep", "left").select(
            "digest_a", "digest_b", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            "component_id", F.lit(True).alias("valid")),
        "caps-result")
    return with_class(rows.drop("embedding", "label"), result).select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
        F.when(F.col("valid"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))


def with_class(rows: DataFrame, result: DataFrame) -> DataFrame:
    """Every row with its class's result.

    Classes with more than one in ``HEAVY_SHARE`` of all rows, so at most that many, are
    broadcast; the others are joined, and none of them is a hot key.
    """
    keys = ["digest_a", "digest_b"]
    bound = result.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * HEAVY_SHARE > bound
    heavy, light = result.filter(often).drop("n"), result.filter(~often).drop("n")
    values = [c for c in heavy.columns if c not in keys]
    one = rows.join(F.broadcast(heavy), keys, "left")
    rest = one.filter("valid is null").drop(*values).join(light, keys, "left")
    return one.filter("valid").unionByName(rest)
