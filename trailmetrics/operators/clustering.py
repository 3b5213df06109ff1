"""Average-linkage clustering of task embeddings and of tool sequences.

Both levels use the same scheme.  Equal items are merged first and carry weights,
so a group of copies is one row.  Each round finds the nearest neighbour of every
cluster within the cut and merges all pairs that are each other's nearest
neighbour; average linkage is reducible, so this gives the flat clusters of the
sequential algorithm.  Ties are ordered by (distance, smaller id, larger id).

A cluster without a neighbour within the cut never gets one (no merge brings two others
closer to it), so it leaves the rounds.  Parts whose clusters fit into one block (counted in each
round) run their remaining rounds in one task.  Otherwise the state of a round is stored, so rounds
survive lost executors and lineage stays short.

For the same reason clusters never merge across the components of the graph of all pairs within
the cut.  Vectors that do not fit into one block are first cut into these components, each a
part of its own: where all vectors are near one big cluster a round merges one pair only, so
rounds over all vectors would grow with their number.

Vectors: every pair of tiles is one task that multiplies two arrays block by block and emits only the best
partner per cluster, never the pairs.  Sequences: a round deals the rows of a part's distance matrix to
tasks of a bounded number of cells, neighbours together; a task works out the edit distances of its rows and
makes all merges that they settle among themselves, not one per cluster, because around a cluster that
is near to many, one merge at a time would take as many rounds as there are.  Distances are never stored:
working them out again in the next round costs less than a matrix that is written, shuffled and read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmetrics.operators.components import components
from trailmetrics.operators.ordering import running_total
from trailmetrics.session import materialize

VECTOR_BLOCK = 2048
SEQUENCE_BLOCK = 2896
SLICE_ROWS = 128  # rows and columns whose edit distances are worked out together
SLICE_COLUMNS = 512
TILE_VALUES = 2 ** 21  # vector values of a tile
LINK_ROWS = 512  # vectors of a tile compared at once with those of the other
TILES = 16  # cut so many ways for the sake of parallel tasks, if blocks allow it
AWAY = 64  # steps from the pair of a tree of neighbours that are told apart
CELLS = 2 ** 23  # distances that a task holds at once (64 MB), unless a single row has more
PAIRS = 2 ** 28  # pairs of sequences that a task compares in a round, as far as clusters are of like size
NEAREST_DDL = "part string, cluster string, partner string, d double"


# --- shared steps ---------------------------------------------------------------


def _tasks(df: DataFrame) -> int:
    """Tasks of a step whose rows are few but heavy (small shuffles would be merged into one)."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def block_pairs(rows: DataFrame, block_count: str) -> DataFrame:
    """Copy every row to the block pairs (i <= j) its block takes part in."""
    other = F.explode(F.sequence(F.lit(0), F.col(block_count) - 1))
    return (
        rows.withColumn("other", other)
        .withColumn("i", F.least("block", "other"))
        .withColumn("j", F.greatest("block", "other"))
        .drop("other")
    )


def mutual_pairs(nearest: DataFrame) -> DataFrame:
    """(part, keep, gone): pairs that are each other's nearest neighbour."""
    order = F.struct(
        "d", F.least("cluster", "partner").alias("lo"), F.greatest("cluster", "partner").alias("hi"),
        "partner",
    )
    best = nearest.groupBy("part", "cluster").agg(F.min(order)["partner"].alias("partner"))
    back = best.select("part", F.col("cluster").alias("partner"), F.col("partner").alias("cluster"))
    return (
        best.join(back, ["part", "cluster", "partner"])
        .filter(F.col("cluster") < F.col("partner"))
        .select("part", F.col("cluster").alias("keep"), F.col("partner").alias("gone"))
    )


def follow(rows: DataFrame, merges: DataFrame) -> DataFrame:
    """Rename merged clusters in ``rows``."""
    renamed = merges.select("part", F.col("gone").alias("cluster"), "keep")
    return (
        rows.join(renamed, ["part", "cluster"], "left")
        .withColumn("cluster", F.coalesce("keep", "cluster"))
        .drop("keep")
    )


def _best_partners(
    part: str, rows: np.ndarray, cols: np.ndarray, distance: np.ndarray, cut: float
) -> pd.DataFrame:
    """Nearest column of every row within the cut.

    Columns are sorted by id, so the first minimum is the tie that comes first in
    the order (distance, smaller id, larger id).
    """
    at = distance.argmin(axis=1)
    d = distance[np.arange(len(rows)), at]
    hit = d <= cut
    return pd.DataFrame({"part": part, "cluster": rows[hit], "partner": cols[at[hit]], "d": d[hit]})


def _merge_chains(
    sums: np.ndarray, at: np.ndarray, size: np.ndarray, cut: float
) -> tuple[list[list[int]], np.ndarray]:
    """All merges that some rows of a distance matrix settle among themselves.

    ``sums`` holds weighted distance sums of the clusters ``at`` to all clusters of their part, ``size``
    the weights of these (both are changed); clusters are sorted by id.  Returns what every row has absorbed, and
    its nearest neighbour (-1: none within the cut, or the row is absorbed).

    A chain goes from cluster to nearest neighbour until two are each other's; they merge and the chain goes on
    from the one before.  Merges in other rows bring no cluster nearer to one of these, so a pair found here
    is a pair of the whole part, and a chain that leaves the rows waits.
    """
    row_of = np.full(len(size), -1)
    row_of[at] = np.arange(len(at))
    sums[np.arange(len(at)), at] = np.inf
    absorbed: list[list[int]] = [[] for _ in at]
    partner = np.full(len(at), -1)
    done = np.zeros(len(at), dtype=bool)  # absorbed, without a neighbour, or waits
    for first in range(len(at)):
        chain = [] if done[first] else [first]
        while chain:
            row = chain[-1]
            mean = np.round(sums[row] / (size[at[row]] * size), 12)
            near = int(mean.argmin())
            if not mean[near] <= cut:
                partner[row], done[row] = -1, True
                chain.pop()
                continue
            partner[row], other = near, row_of[near]
            if other < 0 or done[other]:
                done[chain] = True
                break
            if other not in chain:
                chain.append(other)
                continue
            keep, gone = min(row, other), max(row, other)
            chain = chain[: chain.index(other)] or [keep]
            sums[keep] += sums[gone]
            sums[:, at[keep]] += sums[:, at[gone]]
            sums[:, at[gone]] = np.inf
            size[at[keep]] += size[at[gone]]
            absorbed[keep] += [int(at[gone]), *absorbed[gone]]
            absorbed[gone] = []
            partner[gone], done[gone] = -1, True
    return absorbed, partner


def _merge_in_block(sums: np.ndarray, size: np.ndarray, cut: float) -> np.ndarray:
    """All merges of items that fit into one block: index of the cluster's first item.

    ``sums`` holds weighted distance sums between items, ``size`` their weights; items
    are sorted by id.
    """
    home = np.arange(len(size))
    for keep, gone in enumerate(_merge_chains(sums, home, size, cut)[0]):
        home[gone] = keep
    return home


# --- level 1: cosine distance of embeddings --------------------------------------


def _nearest_vectors(cut: float, block_rows: int):
    def nearest(frame: pd.DataFrame) -> pd.DataFrame:
        i, j = frame["i"].iloc[0], frame["j"].iloc[0]
        frame = frame.sort_values("cluster")
        left, right = frame[frame["block"] == i], frame[frame["block"] == j]
        if left.empty or right.empty:
            return pd.DataFrame(columns=["part", "cluster", "partner", "d"])
        part = frame["part"].iloc[0]
        a = np.stack(left["total"].map(np.asarray)) / left["size"].to_numpy()[:, None]
        b = np.stack(right["total"].map(np.asarray)) / right["size"].to_numpy()[:, None]
        names_a, names_b = left["cluster"].to_numpy(), right["cluster"].to_numpy()
        near, at = np.full(len(b), np.inf), np.zeros(len(b), dtype="int64")  # best row per column
        found = []
        for start in range(0, len(a), block_rows):
            distance = np.round(np.maximum(0.0, 1.0 - a[start: start + block_rows] @ b.T), 12)
            own = np.arange(len(distance))
            if i == j:
                distance[own, start + own] = np.inf
            else:
                first = distance.argmin(axis=0)
                d = distance[first, np.arange(len(b))]
                closer = d < near  # earlier rows have smaller ids and keep ties
                near[closer], at[closer] = d[closer], start + first[closer]
            found.append(_best_partners(part, names_a[start + own], names_b, distance, cut))
        hit = near <= cut
        found.append(pd.DataFrame({"part": part, "cluster": names_b[hit], "partner": names_a[at[hit]], "d": near[hit]}))
        return pd.concat(found)

    return nearest


LINK_SLACK = 1e-9  # a link too many only joins two components, a missing one would part a cluster


def _linked_vectors(cut: float):
    def linked(frame: pd.DataFrame) -> pd.DataFrame:
        """Every vector of a pair of tiles with one of its component there (a spanning forest)."""
        i, j = frame["i"].iloc[0], frame["j"].iloc[0]
        left, right = frame[frame["block"] == i], frame[frame["block"] == j]
        if left.empty or right.empty:
            return pd.DataFrame(columns=["a", "b"])
        unit = lambda side: np.stack(side["total"].map(np.asarray)) / side["size"].to_numpy()[:, None]
        a, b = unit(left), unit(right)
        ahead = 0 if i == j else len(a)
        names = (left if i == j else pd.concat([left, right]))["cluster"].to_numpy()
        home = np.arange(len(names))
        for start in range(0, len(a), LINK_ROWS):
            near = a[start: start + LINK_ROWS] @ b.T >= 1.0 - cut - LINK_SLACK
            for row, hits in enumerate(near, start):
                found = np.unique(home[np.append(np.flatnonzero(hits) + ahead, row)])
                if len(found) > 1:
                    home[np.isin(home, found)] = found[0]
        away = np.flatnonzero(home != np.arange(len(names)))
        return pd.DataFrame({"a": names[home[away]], "b": names[away]})

    return linked


def _vectors_in_block(cut: float):
    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("cluster")
        total = np.stack(frame["total"].map(np.asarray))
        size = frame["size"].to_numpy(dtype="float64")
        # Sum of distances between two items = size * size - product of their totals.
        sums = np.maximum(0.0, np.outer(size, size) - total @ total.T)
        home = _merge_in_block(sums, size.copy(), cut)
        names = frame["cluster"].to_numpy(dtype=object)
        return pd.DataFrame({"part": frame["part"].to_numpy(), "gone": names, "keep": names[home]})

    return merge


def cluster_vectors(items: DataFrame, cut: float, block_rows: int = VECTOR_BLOCK) -> DataFrame:
    """Flat average-linkage clusters on cosine distance: (item, cluster).

    ``items`` has ``item`` and a vector column ``embedding``.  The mean distance of
    two clusters is 1 minus the product of the means of their unit vectors, so a
    cluster is one row: its size and the sum of its unit vectors.  Vectors of unequal
    length are never similar, so each length is a part of its own.
    """
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))
    # Copies of a vector are one item, known by 128 bits of its numbers; zero vectors are at distance 1 from each other.
    marked = items.select(
        "item", "embedding", F.size("embedding").cast("string").alias("width"),
        F.when(length > 0, F.concat_ws("-", F.xxhash64("embedding"), F.xxhash64(F.lit(1), "embedding")))
        .otherwise(F.col("item")).alias("copy"),
    )
    first = marked.groupBy("width", "copy").agg(
        F.min("item").alias("cluster"), F.first("embedding").alias("embedding"), F.count("*").alias("size")
    ).withColumn("_len", length)
    part_of_unit = lambda x: F.when(F.col("_len") > 0, x / F.col("_len")).otherwise(F.lit(0.0))
    first = materialize(
        first.select(
            "width", "copy", F.col("width").alias("part"), "cluster", F.col("size").cast("double").alias("size"),
            F.transform("embedding", lambda x: part_of_unit(x) * F.col("size")).alias("total"),
        ),
        "vector-state",
    )
    state = first.drop("width", "copy")
    # Rounds rename distinct vectors only; their copies follow once, at the end.
    home = first.select("width", "copy", "part", "cluster")
    tasks = _tasks(items)

    def in_tiles(df: DataFrame, large: DataFrame):
        """Rows of large parts dealt to the pairs of their part's tiles."""
        tiles = F.greatest(
            F.ceil(F.col("n") * F.greatest("values", F.lit(1)) / TILE_VALUES),
            F.least(F.lit(TILES), F.ceil(F.col("n") / block_rows))).cast("int")
        cut_up = df.join(large.select("part", tiles.alias("tiles")), "part").withColumn(
            "block", F.expr("cast(pmod(xxhash64(cluster), tiles) as int)"))
        return block_pairs(cut_up, "tiles").repartition(tasks, "part", "i", "j").groupBy("part", "i", "j")

    last_rounds, whole = [], True
    while True:
        sizes = materialize(
            state.groupBy("part").agg(F.count("*").alias("n"), F.max(F.size("total")).alias("values")), "part-sizes")
        large = sizes.filter(F.col("n") > block_rows)
        last_rounds.append(state.join(sizes.filter(F.col("n") <= block_rows).select("part"), "part", "left_semi"))
        if large.isEmpty():
            break
        if whole:
            labels = components(in_tiles(state, large).applyInPandas(_linked_vectors(cut), "a string, b string"))
            labels = labels.select(F.col("node").alias("cluster"), "label")
            named = F.concat_ws("/", "part", "label")
            state = materialize(state.join(labels, "cluster").withColumn("part", named).drop("label"), "vector-parts")
            home = materialize(
                home.join(labels, "cluster", "left")
                .withColumn("part", F.when(F.col("label").isNull(), F.col("part")).otherwise(named)).drop("label"),
                "vector-homes",
            )
            whole = False
            continue
        nearest = materialize(
            in_tiles(state, large).applyInPandas(_nearest_vectors(cut, block_rows), NEAREST_DDL), "vector-nearest")
        merges = materialize(mutual_pairs(nearest), "vector-merges")
        if merges.isEmpty():
            break
        alive = state.join(nearest.select("part", "cluster").distinct(), ["part", "cluster"], "left_semi")
        absorbed = alive.select(
            "part", F.col("cluster").alias("gone"), F.col("size").alias("size2"), F.col("total").alias("total2")
        )
        grown = (
            merges.join(alive.withColumnRenamed("cluster", "keep"), ["part", "keep"])
            .join(absorbed, ["part", "gone"])
            .select(
                "part", F.col("keep").alias("cluster"), (F.col("size") + F.col("size2")).alias("size"),
                F.zip_with("total", "total2", lambda x, y: x + y).alias("total"),
            )
        )
        touched = merges.select("part", F.explode(F.array("keep", "gone")).alias("cluster"))
        state = materialize(
            alive.join(touched, ["part", "cluster"], "left_anti").unionByName(grown), "vector-state"
        )
        home = materialize(follow(home, merges), "vector-homes")
    last = reduce(DataFrame.unionByName, [rows.select("part", "cluster", "size", "total") for rows in last_rounds])
    merges = last.repartition(tasks, "part").groupBy("part").applyInPandas(
        _vectors_in_block(cut), "part string, gone string, keep string")
    return marked.join(follow(home, merges), ["width", "copy"]).select("item", "cluster")


# --- level 2: normalised edit distance of sequences --------------------------------


def _padded(codes: list[np.ndarray], width: int, filler: int) -> np.ndarray:
    out = np.full((len(codes), width), filler, dtype=codes[0].dtype if codes else "uint8")
    for i, x in enumerate(codes):
        out[i, : len(x)] = x
    return out


def _compact(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Both lists with their codes numbered from 2 in as few bytes as hold them."""
    flat = np.concatenate([np.zeros(0, dtype="int64"), *a, *b])
    known, number = np.unique(flat, return_inverse=True)
    cut = np.cumsum([len(x) for x in [*a, *b]])[:-1]
    found = np.split((number + 2).astype(np.min_scalar_type(len(known) + 2)), cut) if a or b else []
    return found[: len(a)], found[len(a):]


def _edit_slice(a: list[np.ndarray], len_b: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Edit distances of a slice of sequences to all sequences of the other side (one per column of ``right``).

    No distance exceeds the longer length, so small numbers (one byte as a rule) hold them.
    """
    len_a = np.array([len(x) for x in a])
    wide_a, wide_b = int(len_a.max(initial=0)), len(right)
    kind = np.min_scalar_type(max(wide_a, wide_b) + 1)
    left = _padded(a, wide_a, 0)
    row = np.empty((wide_b + 1, len(a), len(len_b)), dtype=kind)
    row[:] = np.arange(wide_b + 1, dtype=kind)[:, None, None]
    above, swap = np.empty(row.shape[1:], dtype=kind), np.empty(row.shape[1:], dtype=kind)
    differ = np.empty(row.shape[1:], dtype=bool)
    columns = np.arange(len(len_b))
    result = np.zeros((len(a), len(len_b)), dtype="int32")

    def keep(done: int) -> None:
        for i in np.nonzero(len_a == done)[0]:
            result[i] = row[len_b, i, columns]

    keep(0)
    for p in range(wide_a):
        above[:] = row[0]
        row[0] = p + 1
        own = np.ascontiguousarray(left[:, p, None])
        for q in range(wide_b):
            here = row[q + 1]
            np.not_equal(own, right[q], out=differ)
            np.add(above, differ.view("uint8"), out=swap)
            above[:] = here
            np.minimum(row[q], here, out=here)
            here += kind.type(1)
            np.minimum(here, swap, out=here)
        keep(p + 1)
    return result


def edit_distances(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Edit distance of every pair of two lists of code arrays.

    Slices of rows and columns, longest sequences together, keep the working set small and let
    short sequences stop early.
    """
    a, b = _compact(a, b)
    result = np.zeros((len(a), len(b)), dtype="int32")
    rows_by_length = np.argsort([len(x) for x in a], kind="stable")
    columns_by_length = np.argsort([len(x) for x in b], kind="stable")
    for start in range(0, len(b), SLICE_COLUMNS):
        columns = columns_by_length[start: start + SLICE_COLUMNS]
        right = [b[i] for i in columns]
        len_b = np.array([len(x) for x in right])
        padded = np.ascontiguousarray(_padded(right, int(len_b.max(initial=0)), 1).T)
        for at in range(0, len(a), SLICE_ROWS):
            rows = rows_by_length[at: at + SLICE_ROWS]
            result[np.ix_(rows, columns)] = _edit_slice([a[i] for i in rows], len_b, padded)
    return result


def _ned(edits: np.ndarray, len_a: np.ndarray, len_b: np.ndarray) -> np.ndarray:
    total, ned = np.add.outer(len_a, len_b), 2.0 * edits
    return np.divide(ned, total, out=ned, where=total > 0)  # two empty ones: no edits


def _sequences_in_block(cut: float):
    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("item")
        weight = frame["weight"].to_numpy(dtype="float64")
        codes = [np.asarray(x) for x in frame["codes"]]
        length = np.array([len(x) for x in codes])
        sums = _ned(edit_distances(codes, codes), length, length) * np.outer(weight, weight)
        names = frame["item"].to_numpy(dtype=object)
        home = _merge_in_block(sums, weight.copy(), cut)
        return pd.DataFrame({"part": frame["part"].to_numpy(), "item": names, "cluster": names[home]})

    return merge


# Parts of more than one block.  PART: a part's sequences by id (``items``, ``length``, ``codes`` one
# after the other).  CLUSTERS: its ``n`` clusters, ``first`` item and ``size`` of each, the
# cluster's first item of every item (``home``) and its number (``member_of``, -1: has left), and the block that
# each cluster is dealt to (``place``).  ROWS: a cluster with its nearest neighbour (-1: none within the cut) and the
# clusters that it has absorbed.
PART_DDL = "part string, items array<string>, length array<int>, codes array<int>, weight array<double>"
CLUSTER_DDL = (
    "part string, n int, first array<int>, size array<double>, home array<int>, member_of array<int>, place array<int>"
)
ROW_DDL = "part string, at int, partner int, absorbed array<int>"


def _pack(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("item")
    codes = [np.asarray(x, dtype="int32") for x in frame["codes"]]
    return pd.DataFrame({
        "part": [frame["part"].iloc[0]], "items": [frame["item"].tolist()],
        "length": [np.array([len(x) for x in codes], dtype="int32")],
        "codes": [np.concatenate(codes)], "weight": [frame["weight"].to_numpy(dtype="float64")],
    })


def _no_rows() -> pd.DataFrame:
    return pd.DataFrame(columns=["part", "at", "partner", "absorbed"])


def _codes(one: pd.Series) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Codes, length and weight of a part's sequences."""
    length, weight = np.asarray(one["length"]), np.asarray(one["weight"])
    return np.split(np.asarray(one["codes"]), np.cumsum(length)[:-1]), length, weight


def _first_rows(cut: float):
    def measure(frame: pd.DataFrame) -> pd.DataFrame:
        """Nearest neighbours of one block of a part's sequences among all of them."""
        one = frame.iloc[0]
        codes, length, _ = _codes(one)
        at = np.arange(one["block"] * one["step"], min(len(codes), (one["block"] + 1) * one["step"]))
        mean = np.round(_ned(edit_distances([codes[i] for i in at], codes), length[at], length), 12)
        own = np.arange(len(at))
        mean[own, at] = np.inf
        partner = mean.argmin(axis=1)
        return pd.DataFrame({
            "part": one["part"], "at": at.astype("int32"),
            "partner": np.where(mean[own, partner] <= cut, partner, -1).astype("int32"), "absorbed": [[] for _ in at],
        })

    return measure


def _places(partner: np.ndarray, step: int) -> np.ndarray:
    """Blocks of at most ``step`` clusters that keep a cluster with its nearest neighbour.

    Neighbours form trees, each around a pair.  Trees stay whole if a block holds them, else they are cut by the
    distance from the pair; they follow each other by smallest id, which brings like sequences together.
    """
    place = np.zeros(len(partner), dtype="int64")
    if len(partner) <= step:
        return place
    end = partner
    for _ in range(len(partner).bit_length()):
        end = end[end]
    tree = np.minimum(end, partner[end])
    own = np.arange(len(partner))
    centre = (own == tree) | (own == partner[tree])
    at, away = own, np.zeros(len(partner), dtype="int64")
    for _ in range(AWAY):
        away = away + ~centre[at]
        at = np.where(centre[at], at, partner[at])
    order = np.lexsort((own, away, tree))
    block, room = -1, 0
    for members in np.split(order, np.flatnonzero(np.diff(tree[order])) + 1):
        if len(members) > room:
            block, room = block + 1, step
        place[members] = block + np.arange(len(members)) // step
        block += (len(members) - 1) // step
        room = (room - len(members)) % step if len(members) > step else room - len(members)
    return place


def _advance(block_rows: int):
    def advance(rows: pd.DataFrame, clusters: pd.DataFrame) -> pd.DataFrame:
        """Take over the merges of a part's rows, and deal the clusters with a neighbour to blocks; the others leave."""
        if clusters.empty:
            return pd.DataFrame(columns=["part", "n", "first", "size", "home", "member_of", "place"])
        one = clusters.iloc[0]
        partner, root = np.full(one["n"], -1), np.arange(one["n"])
        partner[rows["at"].to_numpy(dtype="int64")] = rows["partner"].to_numpy(dtype="int64")
        for at, gone in zip(rows["at"], rows["absorbed"]):
            root[np.asarray(gone, dtype="int64")] = at
        first, size, home = (np.asarray(one[c]) for c in ("first", "size", "home"))
        renamed = np.arange(len(home))
        renamed[first] = first[root]
        alive = partner >= 0
        new_of = np.full(one["n"], -1)
        new_of[alive] = np.arange(alive.sum())
        new_of = new_of[root]
        near = new_of[partner[alive]]
        near = np.where(near < 0, np.arange(len(near)), near)  # its neighbour was absorbed by one that leaves
        number = np.full(len(home), -1)
        number[first[alive]] = np.arange(alive.sum())
        member_of = number[renamed[home]]
        members = max(1, int((member_of >= 0).sum()))
        step = max(2, min(block_rows, CELLS // max(1, len(near)), PAIRS * len(near) // members ** 2))
        return pd.DataFrame({
            "part": [one["part"]], "n": [alive.sum()], "first": [first[alive]],
            "size": [np.bincount(root, size, len(root))[alive]], "home": [renamed[home]],
            "member_of": [member_of], "place": [_places(near, step)],
        })

    return advance


def _sums(at: np.ndarray, member_of: np.ndarray, codes: list[np.ndarray], length: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted distance sums of the clusters ``at`` to all clusters, a slice of their sequences at a time."""
    alive = np.flatnonzero(member_of >= 0)
    columns = alive[np.argsort(member_of[alive], kind="stable")]
    starts = np.flatnonzero(np.diff(member_of[columns], prepend=-1))
    others = [codes[i] for i in columns]
    rows = columns[np.isin(member_of[columns], at)]
    sums = np.zeros((len(at), len(starts)))
    step = max(1, CELLS // 4 // len(columns))
    for part in (rows[i: i + step] for i in range(0, len(rows), step)):
        found = _ned(edit_distances([codes[i] for i in part], others), length[part], length[columns])
        found *= weight[part][:, None]
        found *= weight[columns]
        row_of = np.searchsorted(at, member_of[part])
        heads = np.flatnonzero(np.diff(row_of, prepend=-1))
        sums[row_of[heads]] += np.add.reduceat(np.add.reduceat(found, starts, axis=1), heads, axis=0)
    return sums


def _contract(cut: float):
    def contract(blocks: pd.DataFrame) -> pd.DataFrame:
        """Merge what the clusters of a block settle among themselves."""
        one = blocks.iloc[0]
        at = np.flatnonzero(np.asarray(one["place"]) == one["block"])
        if not len(at):
            return _no_rows()
        sums = _sums(at, np.asarray(one["member_of"]), *_codes(one))
        absorbed, partner = _merge_chains(sums, at, np.array(one["size"]), cut)
        rest = [i for i in range(len(at)) if partner[i] >= 0 or absorbed[i]]  # the others are absorbed, or have no neighbour
        return pd.DataFrame({
            "part": one["part"], "at": at[rest].astype("int32"),
            "partner": partner[rest].astype("int32"), "absorbed": [absorbed[i] for i in rest],
        })

    return contract


def cluster_sequences(items: DataFrame, cut: float, block_rows: int = SEQUENCE_BLOCK) -> DataFrame:
    """Flat average-linkage clusters on normalised edit distance, inside each part.

    ``items`` has ``part``, ``item``, ``weight`` and ``codes`` (array of tool codes);
returns (part, item, cluster).  A task holds some rows of a part's distance matrix (``CELLS``
    distances) and short lists of the part's sequences and clusters; no distance is stored.
    """
    state = materialize(
        items.select("part", "item", F.col("weight").cast("double").alias("weight"), "codes"), "sequence-state"
    )
    sizes = materialize(state.groupBy("part").agg(F.count("*").alias("n")), "part-sizes")
    fits = sizes.filter(F.col("n") <= block_rows)
    tasks = _tasks(items)
    finished = (
        state.join(fits.select("part"), "part", "left_semi").repartition(tasks, "part").groupBy("part")
        .applyInPandas(_sequences_in_block(cut), "part string, item string, cluster string")
    )
    sizes = sizes.filter(F.col("n") > block_rows)
    if sizes.isEmpty():
        return finished

    def in_blocks(parts: DataFrame) -> DataFrame:
        """One row per part and block of its rows."""
        step = F.greatest(F.lit(1), F.least(F.lit(block_rows), F.floor(F.lit(CELLS) / F.col("n")))).cast("int")
        return parts.withColumn("step", step).withColumn(
            "block", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / F.col("step")).cast("int")))
        )

    def by(df: DataFrame, *keys: str):
        return df.repartition(tasks, *keys).groupBy(*keys)

    parts = materialize(
        by(state.join(sizes.select("part"), "part", "left_semi"), "part").applyInPandas(_pack, PART_DDL), "sequence-parts"
    )
    everything = F.sequence(F.lit(0), F.size("weight") - 1)
    clusters = parts.select(
        "part", F.size("weight").alias("n"), everything.alias("first"), F.col("weight").alias("size"),
        everything.alias("home"),
    )
    rows = materialize(
        by(in_blocks(parts.drop("items").withColumn("n", F.size("weight"))), "part", "block")
        .applyInPandas(_first_rows(cut), ROW_DDL),
        "sequence-rows",
    )
    homes = []
    while True:
        clusters = materialize(
            by(rows, "part").cogroup(by(clusters, "part"))
            .applyInPandas(_advance(block_rows), CLUSTER_DDL),
            "sequence-clusters",
        )
        homes.append(clusters.filter("n < 2").select("part", "home"))
        clusters = clusters.filter("n > 1")
        if clusters.isEmpty():
            break
        blocks = clusters.select(
            "part", "member_of", "size", "place", F.explode(F.sequence(F.lit(0), F.array_max("place"))).alias("block"))
        rows = materialize(
            by(blocks.join(parts.select("part", "length", "codes", "weight"), "part"), "part", "block")
            .applyInPandas(_contract(cut), ROW_DDL),
            "sequence-rows",
        )
    for home in homes:
        numbered = F.transform("home", lambda h: F.get("items", h))
        named = parts.select("part", "items").join(home, "part").select(
            "part", F.explode(F.arrays_zip("items", numbered.alias("cluster"))).alias("pair"))
        finished = finished.unionByName(named.select(
            "part", F.col("pair.items").alias("item"), F.col("pair.cluster").alias("cluster")))
    return finished


# --- user-facing operators ----------------------------------------------------------


def _ranked(sizes: DataFrame, keys: list[str], prefix: str, label: str) -> DataFrame:
    """Label clusters by size, largest first, then smallest member id."""
    ordered = sizes.withColumn("neg", -F.col("size")).withColumn("one", F.lit(1))
    return running_total(ordered, keys, ["neg", "cluster"], "one", "rank").select(
        *keys, "cluster", "size", F.concat(F.lit(prefix), "rank").alias(label)
    )


def cluster_by_embedding(
    embeddings: DataFrame, similarity_threshold: float = 0.60, min_executions: int = 3,
    block_rows: int = VECTOR_BLOCK,
) -> DataFrame:
    """(workflow_id, task_description, cluster_label) of clusters with enough runs.

    No embedding at all gives no cluster; a single one is a cluster of its own
    whatever the minimum.
    """
    present = embeddings.filter(F.col("embedding").isNotNull())
    items = present.select(F.col("workflow_id").alias("item"), "embedding")
    assigned = materialize(
        cluster_vectors(items, round(1.0 - similarity_threshold, 12), block_rows), "vector-clusters"
    )
    only_one = assigned.limit(2).count() == 1
    sizes = assigned.groupBy("cluster").agg(F.count("*").alias("size")).filter(
        F.lit(only_one) | (F.col("size") >= min_executions)
    )
    labels = _ranked(sizes, [], "cluster_", "cluster_label")
    return (
        assigned.join(labels, "cluster")
        .select(F.col("item").alias("workflow_id"), "cluster_label")
        .join(present.select("workflow_id", "task_description"), "workflow_id")
    )


def subcluster_by_trace(
    traces: DataFrame, key: str = "cluster_label", ned_threshold: float = 0.55
) -> DataFrame:
    """(key, workflow_id, subcluster): runs of a cluster grouped by sequence shape."""
    item = F.concat_ws("\u0001", "tool_sequence")
    shapes = traces.select("workflow_id", F.col(key).alias("part"), "tool_sequence", item.alias("item"))
    tools = traces.select(F.explode("tool_sequence").alias("tool")).distinct()
    codes = running_total(tools.withColumn("one", F.lit(1)), [], ["tool"], "one", "code")
    coded = (
        shapes.groupBy("part", "item").agg(F.count("*").alias("weight"), F.first("tool_sequence").alias("seq"))
    )
    # An empty sequence keeps its row: the join works on exploded tools and back.
    with_codes = (
        coded.select("part", "item", F.posexplode("seq").alias("pos", "tool"))
        .join(codes.select("tool", "code"), "tool")
        .groupBy("part", "item")
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda e: e["code"].cast("int")
            ).alias("codes")
        )
    )
    items = coded.select("part", "item", "weight").join(with_codes, ["part", "item"], "left").withColumn(
        "codes", F.coalesce("codes", F.expr("cast(array() as array<int>)"))
    )
    assigned = cluster_sequences(items, ned_threshold)
    members = materialize(
        shapes.join(assigned, ["part", "item"]).select("part", "workflow_id", "cluster"), "shape-members"
    )
    sizes = members.groupBy("part", "cluster").agg(F.count("*").alias("size"))
    labels = _ranked(sizes, ["part"], "subcluster_", "subcluster")
    return members.join(labels, ["part", "cluster"]).select(
        F.col("part").alias(key), "workflow_id", "subcluster"
    )


def short_descriptions(rows: DataFrame) -> DataFrame:
    """Rows with a description: its length and its first 60 characters (``head``) instead of it."""
    described = F.col("task_description").isNotNull() & (F.trim("task_description") != "")
    return rows.filter(described).withColumn("letters", F.length("task_description")).withColumn(
        "head", F.substring("task_description", 1, 60)).drop("task_description")


def cluster_names(members: DataFrame, key: str = "cluster_label", short: DataFrame | None = None) -> DataFrame:
    """Name per cluster: its shortest description, cut to 60 characters.

    Of equally long texts the smallest counts, and its head is the smallest head, so whole texts never travel.
    ``short``: ``short_descriptions`` by workflow_id, for members that have no texts.
    """
    found = short_descriptions(members) if short is None else members.select("workflow_id", key).join(short, "workflow_id")
    named = found.groupBy(key).agg(F.min(F.struct("letters", "head"))["head"].alias("task_cluster"))
    return members.select(key).distinct().join(named, key, "left").withColumn(
        "task_cluster", F.coalesce("task_cluster", F.lit("Unknown Cluster"))
    )
