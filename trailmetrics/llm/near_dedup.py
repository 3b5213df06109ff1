"""Near-duplicate documents by an inverted join over MinHash signature coordinates.

1. Every document gets its set of distinct word shingles and a signature: the least
   hash of the set under each of ``coordinates`` hash functions.
2. Documents with equal sets are one class, with a number of its own (``rep``).
3. Classes are posted under each (coordinate, value) pair.  Pairs that only one
   class has cannot collide and are skipped; a class with fewer than ``threshold``
   shared pairs cannot reach the threshold and is skipped as well.
4. Of its m shared pairs a class keeps the m - threshold + 1 rarest: two classes that
   agree on ``threshold`` pairs must meet in that prefix.  The long lists outside the
   prefixes are never merged; collisions there are counted by looking both signatures up.
5. Classes that meet are compared: first with the most central class of each list, the one
   whose pairs most classes have (a star, so a large group of copies costs one comparison
   per member).  Where a list still holds several components, its members outside the
   largest one are compared with each other, by longer signatures of ``LONG_COORDINATES``
   one-byte values, and with the whole largest component, by their shingle sets.  Both work
   on pairs of blocks, so no task holds a whole group and only near pairs leave the blocks.
6. Pairs with enough collisions are confirmed on the full shingle sets.

``threshold`` is the largest count that a pair of exactly the wanted similarity misses
with a chance below ``MISS``.

Null or blank texts have no shingles and are linked with nothing; rows without a doc_id
are returned unlinked; rows that repeat a doc_id are compared by their own texts.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmetrics.llm.common import as_bytes, id_and_text, map_batches, quoted, whole_groups
from trailmetrics.operators.components import components
from trailmetrics.session import materialize

COORDINATES = 64
LONG_COORDINATES = 512  # of the one-byte signatures that narrow down block comparisons
MISS = 1e-9
BLOCK = 512
_VALUE_BITS = 57
_SHIFT = np.uint64(64 - _VALUE_BITS)


@functools.cache
def match_threshold(percent: int, coordinates: int = COORDINATES) -> int:
    """Collisions that a pair of similarity ``percent`` reaches but for a chance of ``MISS``."""
    j, missed = percent / 100, 0.0
    for t in range(coordinates):
        missed += math.comb(coordinates, t) * j**t * (1 - j) ** (coordinates - t)
        if missed >= MISS:
            return max(t, 1)
    return coordinates


def words_of(text: bytes) -> list[bytes]:
    """Lower-case (A-Z only) words between ASCII white space."""
    return text.lower().split()


def shingle_set(text: bytes, width: int) -> set[tuple[bytes, ...]]:
    """Distinct runs of ``width`` words; a shorter text is one run; none without words."""
    words = words_of(text)
    if not words:
        return set()
    if len(words) <= width:
        return {tuple(words)}
    return set(zip(*(words[i:] for i in range(width))))


def hash_family(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20240917))
    factors = rng.integers(0, 2**64, coordinates, dtype=np.uint64) | np.uint64(1)
    return factors, rng.integers(0, 2**64, coordinates, dtype=np.uint64)


_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(len(h) - width + 1, 1)
    runs = np.full(n, min(len(h), width), np.uint64)
    for i in range(min(width, len(h))):
        runs = (runs ^ h[i : i + n]) * _MIX[i % 3]
        runs ^= runs >> np.uint64(29)
    return np.unique(runs)


def least_hashes(hashes: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The least value of the set under each hash function."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), 1024):
        part = hashes[None, start : start + 1024] * factors[:, None]
        part += offsets[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return least


def signature(hashes: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One (coordinate, value) pair per coordinate, packed into 64 bits."""
    least = least_hashes(hashes, factors, offsets)
    coordinate = np.arange(len(factors), dtype=np.uint64) << np.uint64(_VALUE_BITS)
    return (coordinate | (least >> _SHIFT)).view(np.int64)


SIGNATURES = "doc_id bigint, text_hash bigint, n_shingles bigint, set_a bigint, set_b bigint, pairs array<bigint>"


def signatures(docs: DataFrame, width: int, coordinates: int) -> DataFrame:
    factors, offsets = hash_family(coordinates)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, pairs = [], [], []
            for text in as_bytes(batch.column(1)):
                hashes = shingle_hashes(text, width)
                counts.append(len(hashes))
                digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                pairs.append(signature(hashes, factors, offsets) if len(hashes) else None)
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(halves[:, 0].copy()),
                pa.array(halves[:, 1].copy()), pa.array(pairs, pa.list_(pa.int64())),
            ], names=["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "pairs"])

    return map_batches(docs, work, SIGNATURES)


def indexed_classes(classes: DataFrame, threshold: int) -> DataFrame:
    """(rep, shared, prefix) of the classes that can reach the threshold.

    ``shared`` holds the signature pairs that another class has too, rarest first.
    """
    postings = classes.select("rep", F.explode("pairs").alias("pair"))
    lists = postings.groupBy("pair").agg(F.count("*").alias("n")).filter("n > 1")
    shared = (
        postings.join(lists, "pair")
        .groupBy("rep").agg(F.collect_list(F.struct("n", "pair")).alias("found"), F.sum("n").alias("central"))
        .filter(F.size("found") >= threshold)
        .select("rep", "central", F.transform(F.array_sort("found"), lambda x: x["pair"]).alias("shared"))
    )
    return shared.withColumn("prefix", F.slice("shared", 1, F.size("shared") - threshold + 1))


def collisions(left: str, right: str) -> Column:
    return F.size(F.array_intersect(left, right))


def confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets are similar enough."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, other in zip(as_bytes(batch.column(2)), as_bytes(batch.column(3))):
                a, b = shingle_set(one, width), shingle_set(other, width)
                both = len(a & b)
                keep.append(100 * both >= percent * (len(a) + len(b) - both) > 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])

    with_texts = (
        pairs.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
        .join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a")
        .select("a", "b", "text_a", "text_b")
    )
    return map_batches(with_texts, work, "a bigint, b bigint")


def star_pairs(index: DataFrame, threshold: int) -> DataFrame:
    """Each class with the most central class of every prefix list it is in."""
    posted = index.select("rep", F.struct("central", -F.col("rep")).alias("weight"), F.explode("prefix").alias("pair"))
    centres = posted.groupBy("pair").agg(F.max("weight").alias("most"), F.count("*").alias("n")).filter("n > 1")
    pairs = posted.join(centres, "pair").select((-F.col("most.col2")).alias("a"), F.col("rep").alias("b")).filter(
        "a <> b").distinct()
    return colliding(pairs, index, threshold)


def colliding(pairs: DataFrame, index: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) whose signatures collide at least ``threshold`` times."""
    return (
        pairs.join(index.select(F.col("rep").alias("b"), F.col("shared").alias("sb")), "b")
        .join(index.select(F.col("rep").alias("a"), F.col("shared").alias("sa")), "a")
        .filter(collisions("sa", "sb") >= threshold).select("a", "b")
    )


def long_signatures(texts: DataFrame, width: int) -> DataFrame:
    """(rep, long): one byte per coordinate; the first ``COORDINATES`` bytes serve as a first look."""
    factors, offsets = hash_family(LONG_COORDINATES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                (least_hashes(shingle_hashes(text, width), factors, offsets) >> np.uint64(32)).astype(np.uint8).tobytes()
                for text in as_bytes(batch.column(1))
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["rep", "long"])

    return map_batches(texts.select("rep", "text"), work, "rep bigint, long binary")


def block_pairs(one: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows of both sides (key, rep, ...) dealt to pairs of blocks of about ``BLOCK`` rows each."""
    blocks = lambda rows, name: rows.groupBy(key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    sizes = blocks(one, "n_one").join(blocks(other, "n_two"), key)
    block = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = one.join(sizes, key).withColumn("one", block("n_one")).withColumn("two", every("n_two"))
    right = other.join(sizes, key).withColumn("two", block("n_two")).withColumn("one", every("n_one"))
    names = [*one.columns, "one", "two"]
    return left.select(*names, F.lit(True).alias("left")).union(right.select(*names, F.lit(False).alias("left")))


def in_blocks(sides: DataFrame, key: str, match: Callable[[pa.Table], np.ndarray]) -> DataFrame:
    """(a, b) that ``match`` finds in each pair of blocks."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, bounds in whole_groups(batches, [key, "one", "two"]):
            left = data.column("left").to_numpy(zero_copy_only=False)
            for a, b in zip(bounds[:-1], bounds[1:]):
                if left[a:b].any() and not left[a:b].all():
                    pairs = match(data.slice(a, b - a))
                    if len(pairs):
                        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    dealt = sides.repartition(key, "one", "two").sortWithinPartitions(key, "one", "two")
    return map_batches(dealt, work, "a bigint, b bigint")


def remaining_pairs(
    index: DataFrame, texts: DataFrame, long: DataFrame, labels: DataFrame, width: int, percent: int
) -> DataFrame:
    """Pairs of different components that meet in a list and look near enough."""
    component = materialize(
        index.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left")
        .select("rep", F.coalesce("label", "rep").alias("label"), "prefix"), "near-components")
    member = component.select("rep", "label", F.explode("prefix").alias("pair"))
    mixed = (
        member.groupBy("pair", "label").agg(F.count("*").alias("n"))
        .groupBy("pair").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.count("*").alias("labels"))
        .filter("labels > 1").select("pair", "main")
    )
    outside = materialize(member.join(mixed, "pair").filter("label <> main"), "near-outside")

    # With each other, list by list.
    several = outside.groupBy("pair").agg((F.max("label") > F.min("label")).alias("several")).filter("several")
    listed = outside.join(several.select("pair"), "pair", "left_semi").select("pair", "rep", "label")
    sides = block_pairs(listed, listed, "pair").join(long, "rep")

    def by_signature(data: pa.Table) -> np.ndarray:
        values = np.frombuffer(b"".join(data.column("long").to_pylist()), np.uint8).reshape(data.num_rows, -1)
        return block_matches(values, data.column("rep").to_numpy(), data.column("label").to_numpy(),
                             data.column("left").to_numpy(zero_copy_only=False), percent)

    each_other = in_blocks(sides, "pair", by_signature)

    # With the largest component of their lists, which is read once per block of outsiders.
    towards = outside.select("main", "rep").distinct()
    inside = component.select(F.col("label").alias("main"), "rep")
    with_main = block_pairs(towards, inside, "main").join(texts, "rep")

    def by_set(data: pa.Table) -> np.ndarray:
        sets = [shingle_hashes(text, width) for text in as_bytes(data.column("text").combine_chunks())]
        return set_matches(sets, data.column("rep").to_numpy(), data.column("left").to_numpy(zero_copy_only=False), percent)

    return each_other.union(in_blocks(with_main, "main", by_set)).distinct()


def set_matches(sets: list[np.ndarray], rep: np.ndarray, left: np.ndarray, percent: int) -> np.ndarray:
    """(smaller, larger) rows of the two sides whose sets are similar enough."""
    ones, others = np.flatnonzero(left), np.flatnonzero(~left)
    sizes = np.array([len(s) for s in sets])
    values = np.concatenate([sets[i] for i in others])
    owner = np.repeat(np.arange(len(others)), sizes[others])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    found = []
    for i in ones:
        start, end = np.searchsorted(values, sets[i], "left"), np.searchsorted(values, sets[i], "right")
        run = end - start
        ahead = np.cumsum(run) - run
        hits = np.repeat(start - ahead, run) + np.arange(int(run.sum()))
        both = np.bincount(owner[hits], minlength=len(others))
        near = np.flatnonzero(100 * both >= percent * (sizes[i] + sizes[others] - both))
        found += [(min(rep[i], rep[others[j]]), max(rep[i], rep[others[j]])) for j in near]
    return np.array(found, np.int64).reshape(-1, 2)


def block_matches(
    values: np.ndarray, rep: np.ndarray, label: np.ndarray, left: np.ndarray, percent: int
) -> np.ndarray:
    """(smaller, larger) classes of different components whose signatures agree often enough."""
    ones, others = np.flatnonzero(left), np.flatnonzero(~left)
    columns = np.ascontiguousarray(values[others, :COORDINATES].T)
    least, least_long = match_threshold(percent, COORDINATES), match_threshold(percent, values.shape[1])
    found = []
    for start in range(0, len(ones), 256):
        rows = ones[start : start + 256]
        equal = np.zeros((len(rows), len(others)), np.uint8)
        for c, column in enumerate(columns):
            equal += values[rows, c][:, None] == column[None, :]
        i, j = np.nonzero((equal >= least) & (label[rows][:, None] != label[others][None, :]))
        for at in range(0, len(i), 1 << 16):
            one, other = rows[i[at : at + (1 << 16)]], others[j[at : at + (1 << 16)]]
            near = (values[one] == values[other]).sum(axis=1) >= least_long
            found.append(np.sort(np.stack([rep[one[near]], rep[other[near]]], axis=1), axis=1))
    return np.concatenate(found) if found else np.empty((0, 2), np.int64)


def text_hash(text: Column) -> Column:
    """Tells the texts of rows that repeat a doc_id apart."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def labelled_rows(docs: DataFrame, width: int, percent: int, coordinates: int = COORDINATES) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and kept, per row."""
    threshold = match_threshold(percent, coordinates)
    rows = id_and_text(docs).withColumn("text_hash", text_hash(F.col("text")))
    signed = materialize(signatures(rows, width, coordinates), "near-signatures")
    usable = signed.filter("n_shingles > 0 and doc_id is not null")
    sets, row = ["set_a", "set_b"], ["doc_id", "text_hash"]
    # A class is known by its number; a doc_id that repeats with other texts can come first in several.
    classes = materialize(
        usable.groupBy(*sets).agg(F.min(F.struct(*row)).alias("first"))
        .select(F.monotonically_increasing_id().alias("rep"), *sets, "first.*"), "near-classes")
    represented = usable.join(classes, [*sets, *row]).select("rep", "pairs").dropDuplicates(["rep"])
    index = materialize(indexed_classes(represented, threshold), "near-index")
    indexed = classes.join(index.select("rep"), "rep", "left_semi")
    texts = materialize(rows.join(indexed.select("rep", *row), row).select("rep", "text"), "near-texts")
    links = materialize(confirm(star_pairs(index, threshold), texts, width, percent), "near-links")
    labels = components(links)
    long = materialize(long_signatures(texts, width), "near-long")
    rest = materialize(confirm(remaining_pairs(index, texts, long, labels, width, percent), texts, width, percent), "near-links")
    if not rest.isEmpty():
        labels = components(links.union(rest))
    grouped = classes.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left")
    least = grouped.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    found = grouped.join(least, "label", "left").select(*sets, F.coalesce("component_id", "doc_id").alias("component_id"))
    narrow = signed.select(*row, "n_shingles", *sets)
    alone = (F.col("n_shingles") == 0) | F.col("component_id").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return narrow.join(found, sets, "left").select(
        *row, "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, coordinates: int = COORDINATES
) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept, per row."""
    return labelled_rows(docs, width, percent, coordinates).drop("text_hash")


def keepers(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns whatever their names."""
    extra = labelled_rows(docs, width, percent).filter(~F.col("kept")).select("doc_id", "text_hash").distinct()
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_hash(F.col("text")).alias("text_hash"),
                       F.struct(*map(quoted, docs.columns)).alias("row"))
    return rows.join(extra, ["doc_id", "text_hash"], "left_anti").select("row.*")
