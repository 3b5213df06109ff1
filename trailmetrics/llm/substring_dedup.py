"""Repeated byte strings across a corpus, by prefix-free parsing.

``WIDTH`` bytes are the least repeat.  A rolling hash is taken of every ``GRAM`` bytes, and in
each window of ``WIDTH`` bytes the least hash (the rightmost on ties) is its trigger.  The
windows that share a trigger form a phrase, which reaches ``WIDTH - 1`` bytes past its last
window, so no phrase is a prefix of another and a phrase says all about its windows.

* Dictionary and parse: every text becomes a row of phrases.  All occurrences of a phrase are
  ordered by position; all but the first are repeats as a whole.  Copies inside an input chunk
  are settled there, so a passage that every text has costs one row per chunk.
* Suffixes of the dictionary: phrases that share a trigger but differ elsewhere may still share
  some windows.  Only their first occurrences are opened: their windows (suffixes of the
  phrase, cut at ``WIDTH`` bytes) are put in order with their equals, and again all but the
  first are repeats.  This goes by cells first: the ``CELL`` windows at the same distances from
  the trigger have ``WIDTH - CELL + 1`` bytes in common, their core.  Equal cells are settled
  as a whole, cells whose core nobody shares have no repeat, and only the first occurrences of
  different cells with one core are opened to single windows.

Equal windows have equal triggers at equal distances, so these steps see every repeat.  The order that puts
equal suffixes side by side is that of two 64-bit fingerprints rather than of the bytes; only
equality and position matter here.  Triggers, phrases and suffixes are dealt over tasks by
fingerprint, nothing is gathered by document but its own list of repeats.

Null texts are empty; texts below ``WIDTH`` bytes have no repeats.  Rows without a doc_id come
last, in the order of their texts' hashes.  Rows that repeat a doc_id with another text stand in
the order of their texts' hash; rows that repeat both count as one document and get the same
result.  A document is known by two numbers: its doc_id and 0, or, where a doc_id repeats or is
missing, hashes of the text with 63 or 125 bits.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmetrics.llm.common import id_and_text, map_batches
from trailmetrics.session import materialize

WIDTH = 100
GRAM = 32
CHUNK = 1 << 21
LAST = 1 << 62  # order of rows without a doc_id: above it

CELL = 8

# A place is a run of windows: it packs the offset of the first window (32 bits), that window's
# distance from its trigger (7 bits) and the further windows (7 bits).
RUN_BITS, AHEAD_BITS, OFFSET_BITS = 7, 7, 32

ROWS = "one bigint, two bigint, doc bigint, sub bigint, place bigint"
DOCUMENT = ["doc", "sub"]
_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


class RollingHash:
    """Hashes of all byte strings of a chunk from running sums, modulo 2**64."""

    def __init__(self, seed: int, longest: int) -> None:
        rng = np.random.Generator(np.random.PCG64(seed))
        self._byte = rng.integers(0, 2**64, 256, dtype=np.uint64)
        base = int(rng.integers(0, 2**64, dtype=np.uint64)) | 5
        self._up = np.full(longest + 1, base, np.uint64)
        self._down = np.full(longest + 1, pow(base, -1, 2**64), np.uint64)
        self._up[0] = self._down[0] = 1
        np.multiply.accumulate(self._up, out=self._up)
        np.multiply.accumulate(self._down, out=self._down)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self._byte[data] * self._up[: len(data)], out=out[1:])
        return out

    def between(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((sums[end] - sums[start]) * self._down[start])

    def all_of(self, sums: np.ndarray, width: int) -> np.ndarray:
        n = len(sums) - width
        return mixed((sums[width:] - sums[:n]) * self._down[:n])


@functools.cache
def hashes() -> tuple[RollingHash, RollingHash]:
    return RollingHash(101, CHUNK + WIDTH), RollingHash(202, CHUNK + WIDTH)


def packed(offset: np.ndarray, ahead: np.ndarray | int, run: np.ndarray | int) -> np.ndarray:
    return (offset << (AHEAD_BITS + RUN_BITS)) | (ahead << RUN_BITS) | run


def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """offset, ahead, run"""
    field = lambda shift, bits: (place >> shift) & ((1 << bits) - 1)
    return field(AHEAD_BITS + RUN_BITS, OFFSET_BITS), field(RUN_BITS, AHEAD_BITS), field(0, RUN_BITS)


class Chunk:
    """Consecutive texts (or a slice of a long one) in one row of bytes.

    ``first`` holds where each text starts in the row, ``offset`` what came before in its text.
    """

    def __init__(self) -> None:
        self.parts: list[bytes] = []
        self.first: list[int] = []
        self.offset: list[int] = []
        self.doc: list[int] = []
        self.sub: list[int] = []
        self.places_in: list[np.ndarray | None] = []
        self.size = 0

    def add(self, part: bytes, offset: int, doc: int, sub: int, places: np.ndarray | None) -> None:
        self.parts.append(part)
        self.first.append(self.size)
        self.offset.append(offset)
        self.doc.append(doc)
        self.sub.append(sub)
        self.places_in.append(places)
        self.size += len(part)

    def data(self) -> np.ndarray:
        return np.frombuffer(b"".join(self.parts), np.uint8)

    def places(
        self, start: np.ndarray, ahead: np.ndarray | int, run: np.ndarray | int
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(doc, sub, place) of runs of windows that start at these bytes of the row."""
        text = np.searchsorted(np.array(self.first), start, "right") - 1
        offset = start - np.array(self.first)[text] + np.array(self.offset, np.int64)[text]
        return np.array(self.doc, np.int64)[text], np.array(self.sub, np.int64)[text], packed(offset, ahead, run)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First window, last window and trigger (bytes of the row) of the given places.

        Windows outside a slice of a long text are left to its other slices.
        """
        parts = []
        ends = [*self.first[1:], self.size]
        for first, end, before, places in zip(self.first, ends, self.offset, self.places_in):
            offset, ahead, run = unpacked(places)
            start = offset - before + first
            low, high = np.maximum(start, first), np.minimum(start + run, end - WIDTH)
            parts.append(np.stack([low, high, start + ahead])[:, low <= high])
        low, high, trigger = np.concatenate(parts, axis=1)
        return low, high, trigger


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Texts with at least one window, long ones in slices that share ``WIDTH - 1`` bytes.

    Batches are (doc, sub, text) or (doc, sub, text, places).
    """
    held = Chunk()
    for doc, sub, text, places in (row for batch in batches for row in rows_of(batch)):
        if len(text) < WIDTH:
            continue
        for start in range(0, len(text) - WIDTH + 1, CHUNK - WIDTH + 1):
            part = text[start : start + CHUNK]
            if held.size + len(part) > CHUNK:
                yield held
                held = Chunk()
            held.add(part, start, doc, sub, places)
    if held.size:
        yield held


def trigger_of_windows(grams: np.ndarray) -> np.ndarray:
    """Place of the least gram hash in each window, the rightmost on ties."""
    low = _U((1 << 24) - 1)
    place = np.arange(len(grams), dtype=np.uint64)
    least = (grams & ~low) | (low - place)
    span, width = 1, WIDTH - GRAM + 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: span - width], least[width - span :])
    return (low - (least & low)).astype(np.int64)


def phrases(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(trigger hash, phrase hash, first window, its distance, further windows) of the chunk's phrases."""
    one, two = hashes()
    data = chunk.data()
    sums = one.sums(data)
    grams = one.all_of(sums, GRAM)
    trigger = trigger_of_windows(grams)
    inside = np.ones(len(trigger) + 1, bool)
    for end in chunk.first[1:]:
        inside[max(end - WIDTH + 1, 0) : end] = False
    inside[-1] = False
    new = inside[:-1].copy()
    new[1:] &= ~inside[:-2] | (trigger[1:] != trigger[:-1])
    first = np.flatnonzero(new)
    final = inside[:-1] & ~inside[1:]
    final[:-1] |= inside[:-2] & (trigger[1:] != trigger[:-1])
    further = np.flatnonzero(final) - first
    at = trigger[first]
    own = two.between(two.sums(data), first, first + further + WIDTH)
    own = mixed(own ^ ((at - first) << 8 | further).astype(np.uint64))
    return grams[at].view(np.int64), own.view(np.int64), first, at - first, further


def settled(one: np.ndarray, two: np.ndarray, doc: np.ndarray, sub: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """First occurrences with their fingerprints; further ones, without, are known repeats.

    A row that repeats another in all respects comes from a repeated input row and goes.
    """
    order = np.lexsort((place, sub, doc, two, one))
    one, two, doc, sub, place = (c[order] for c in (one, two, doc, sub, place))
    repeat, same = np.zeros(len(one), bool), np.zeros(len(one), bool)
    repeat[1:] = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
    same[1:] = repeat[1:] & (doc[1:] == doc[:-1]) & (sub[1:] == sub[:-1]) & (place[1:] == place[:-1])
    if same.any():
        one, two, doc, sub, place, repeat = (c[~same] for c in (one, two, doc, sub, place, repeat))
    return pa.RecordBatch.from_arrays(
        [pa.array(one, mask=repeat), pa.array(two, mask=repeat), pa.array(doc), pa.array(sub), pa.array(place)],
        names=["one", "two", "doc", "sub", "place"])


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes, np.ndarray | None]]:
    docs, subs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())
    places = batch.column(3) if batch.num_columns > 3 else None
    for i, (doc, sub, text) in enumerate(zip(docs, subs, texts)):
        yield doc, sub, text.as_py(), None if places is None else places[i].values.to_numpy()


def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The phrases of (doc, sub, text)."""
    for chunk in chunks(batches):
        trigger, own, first, ahead, further = phrases(chunk)
        yield settled(trigger, own, *chunk.places(first, ahead, further))


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``counts`` its row number, repeated, and 0, 1, ... up to the count."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def open_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Core and content of the cells of opened phrases, from (doc, sub, text, places)."""
    one, two = hashes()
    for chunk in chunks(batches):
        low, high, trigger = chunk.runs()
        if not len(low):
            continue
        nearest = (trigger - high) // CELL  # cells count away from the trigger
        row, step = spread((trigger - low) // CELL - nearest + 1)
        cell, at = nearest[row] + step, trigger[row]
        first = np.maximum(low[row], at - CELL * cell - (CELL - 1))
        last = np.minimum(high[row], at - CELL * cell)
        sums, other = one.sums(data := chunk.data()), two.sums(data)
        core = one.between(sums, at - CELL * cell, at - CELL * cell - (CELL - 1) + WIDTH)
        content = two.between(other, first, last + WIDTH)
        core = mixed(core ^ cell.astype(np.uint64))
        content = mixed(content ^ ((at - first) << 8 | (last - first)).astype(np.uint64))
        yield settled(core.view(np.int64), content.view(np.int64), *chunk.places(first, at - first, last - first))


def open_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two fingerprints of each window of opened cells, from (doc, sub, text, places)."""
    one, two = hashes()
    for chunk in chunks(batches):
        low, high, _ = chunk.runs()
        if not len(low):
            continue
        row, step = spread(high - low + 1)
        start = low[row] + step
        end = start + WIDTH
        sums, other = one.sums(data := chunk.data()), two.sums(data)
        yield settled(one.between(sums, start, end).view(np.int64),
                      two.between(other, start, end).view(np.int64), *chunk.places(start, 0, 0))


def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Settle rows that are sorted by fingerprints and position.

    All but the first of equal rows are repeats (``open`` false).  First rows whose first
    fingerprint also comes with another second one are to be opened (``open`` true).  Only
    the last row and one undecided first row pass from batch to batch.  Rows that repeat the
    one before in all respects come from repeated input rows and go.
    """
    before: tuple[int, ...] | None = None
    kinds, waiting = 0, None  # of the first fingerprint at the end of the last batch
    for batch in batches:
        known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        loose = batch.filter(pa.array(~known))
        if loose.num_rows:
            yield result(*(loose.column(i).to_numpy() for i in (2, 3, 4)), np.zeros(loose.num_rows, bool))
        rows = batch.filter(pa.array(known))
        if not rows.num_rows:
            continue
        fields = [rows.column(i).to_numpy() for i in range(5)]
        again = np.ones(rows.num_rows, bool)
        again[0] = before == tuple(int(f[0]) for f in fields)
        for f in fields:
            again[1:] &= f[1:] == f[:-1]
        if again.any():
            fields = [f[~again] for f in fields]
            if not len(fields[0]):
                continue
        one, two, doc, sub, place = fields
        new_one, new_two = np.ones(len(one), bool), np.ones(len(one), bool)
        new_one[1:] = one[1:] != one[:-1]
        new_two[1:] = new_one[1:] | (two[1:] != two[:-1])
        if before is not None and before[0] == one[0]:
            new_one[0] = False
            new_two[0] = before[1] != two[0]
        else:
            kinds, waiting = 0, None
        group = np.cumsum(new_one)
        counts = np.bincount(group, weights=new_two).astype(np.int64)
        counts[0] += kinds  # the group that goes on from the last batch
        opened = new_two & (counts[group] > 1)
        told = ~new_two | opened
        yield result(doc[told], sub[told], place[told], opened[told])
        if waiting is not None and counts[0] > 1:
            yield result(*(np.array([w]) for w in waiting), np.ones(1, bool))
            waiting = None
        kinds = int(counts[group[-1]])
        if kinds > 1:
            waiting = None
        elif group[-1] != 0:
            at = np.flatnonzero(group == group[-1])[0]
            waiting = (int(doc[at]), int(sub[at]), int(place[at]))
        before = tuple(int(f[-1]) for f in fields)


def result(doc: np.ndarray, sub: np.ndarray, place: np.ndarray, opened: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(doc), pa.array(sub), pa.array(place), pa.array(opened)], names=["doc", "sub", "place", "open"])


def in_order(rows: DataFrame) -> DataFrame:
    """Rows dealt by fingerprint (settled ones anywhere), sorted by fingerprints and position."""
    dealt = F.coalesce(F.col("one"), F.xxhash64("doc", "sub", "place"))
    sorted_rows = rows.repartition(dealt).sortWithinPartitions("one", "two", "doc", "sub", "place")
    return map_batches(sorted_rows, repeats, "doc bigint, sub bigint, place bigint, open boolean")


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Remove the repeats of each text: (doc, sub, text, places)."""
    for batch in batches:
        columns: list[list] = [[] for _ in range(4)]
        ids = [None if sub & 1 else doc for doc, sub in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        for text, places in zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3)):
            spans, removed, kept = 0, 0, text
            if places.is_valid and len(text) >= WIDTH:
                offset, _, run = unpacked(places.values.to_numpy())
                edge = np.zeros(len(text) + 1, np.int64)
                np.add.at(edge, offset, 1)
                np.add.at(edge, offset + run + WIDTH, -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed = int(gone.sum())
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            for column, value in zip(columns, (len(text), removed, spans, hashlib.sha256(kept).hexdigest())):
                column.append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in columns[:3]),
             pa.array(columns[3], pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def by_document(found: DataFrame, opened: bool) -> DataFrame:
    return found.filter(F.col("open") == opened).groupBy(*DOCUMENT).agg(F.collect_list("place").alias("places"))


def identified(docs: DataFrame) -> DataFrame:
    """The two numbers of the document, and its text; only rows without a doc_id have an odd ``sub``."""
    rows = id_and_text(docs)
    repeated = materialize(
        rows.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1")
        .select("doc_id", F.lit(True).alias("again")), "repeated-ids")
    missing = F.col("doc_id").isNull()
    text_hash = F.xxhash64("text")
    # The numbers are never null and known not to be, so that all joins share one shuffle of the texts.
    sub = F.when(missing, text_hash.bitwiseOR(F.lit(1))).when(F.col("again"), text_hash.bitwiseAND(F.lit(-2)))
    return rows.join(repeated, "doc_id", "left").select(
        F.coalesce("doc_id", F.lit(LAST) + F.pmod(F.xxhash64(F.lit(1), "text"), F.lit(LAST)), F.lit(LAST)).alias("doc"),
        F.coalesce(sub, F.lit(0).cast("bigint")).alias("sub"), "text")


def repeated_places(rows: DataFrame) -> DataFrame:
    """(doc, sub, places) of all repeats, from (doc, sub, text).

    Every step joins the same columns of the texts, so that they are shuffled once.
    """
    steps = [in_order(map_batches(rows, parse, ROWS))]
    for work in (open_cells, open_windows):
        opened = rows.join(by_document(steps[-1], True), DOCUMENT).select(*DOCUMENT, "text", "places")
        steps.append(in_order(map_batches(opened, work, ROWS)))
    every = steps[0].union(steps[1]).union(steps[2])
    return by_document(every, False)


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    rows = identified(docs)
    return map_batches(
        rows.join(repeated_places(rows), DOCUMENT, "left").select(*DOCUMENT, "text", "places"), cut,
        "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
