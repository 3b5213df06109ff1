"""Spelling variants by Bloom-guided neighbourhoods.

Words are counted over whole texts; copies inside a task's chunk are merged before they
move.  Every word of the vocabulary then generates its edits (deletions, and replacements
by a later letter; an insertion is the other word's deletion) and probes them against
blocked Bloom filters, one shard per word length, which are broadcast.  Only positives are
shuffled: an exact join with the vocabulary removes the false ones.

The filters of one pass hold at most ``FILTER_BLOCKS`` blocks of 64 bits.  A vocabulary that
needs more is dealt by hash to several passes, each with its own filters, so the broadcast
does not grow with the data.  A word has at most 181 neighbours a letter, which bounds the
rows of every join key; forms rise in count, so roots are found from the top, level by level,
in at most log(largest count) rounds.

Null texts have no words; a null doc_id draws like an empty one.  Repeated rows count again.
A run of any length is one word.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmetrics.llm.common import id_and_text, map_batches
from trailmetrics.session import materialize

DELETE_EVERY = 199
LEAST_LENGTH = 6
LEAST_COUNT = 5
FORM_RATIO = 5

#: A word's letters, as Latin-1 codes (A-Z are lower-cased before).
LETTERS = bytes(range(ord("a"), ord("z") + 1)) + bytes(range(0xC0, 0x100))

CHUNK_WORDS = 1 << 18
FILTER_BLOCKS = 1 << 22
BITS_PER_WORD = 24
BITS_SET = 5
PROBES = 1 << 20

# --- words ----------------------------------------------------------------------------


def run_table() -> bytes:
    """Latin-1 codes: letters stay, A-Z become a-z, all else parts words."""
    table = bytearray(b" " * 256)
    for letter in LETTERS:
        table[letter] = letter
    for letter in range(ord("A"), ord("Z") + 1):
        table[letter] = letter + 32
    return bytes(table)


def document_words(text: str, doc_id: int | None, table: bytes, every: int, least: int) -> Iterator[tuple[bytes, int]]:
    """(word, times) of one text, in Latin-1; one code point of a drawn run is lost."""
    base = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(text.encode("latin-1", "replace").translate(table).split()).items():
        if len(run) >= least:
            drawn = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), base)
            if drawn % every == 0:
                at = drawn % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < least:
                    continue
            yield run, n


def word_counts(docs: DataFrame, every: int = DELETE_EVERY, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, n) over all texts."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held = run_table(), Counter()

        def batch_of(counts: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(counts.values(), pa.int64())],
                names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for word, n in document_words(text.as_py(), doc_id, table, every, least_length):
                    held[word] += n
                if len(held) >= CHUNK_WORDS:
                    yield batch_of(held)
                    held = Counter()
        if held:
            yield batch_of(held)

    parts = map_batches(id_and_text(docs), work, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


# --- codes and filters ----------------------------------------------------------------

U64 = np.uint64
STEP = U64(0x9E3779B97F4A7C15)  # odd, so it has an inverse
INVERSE = U64(pow(int(STEP), -1, 1 << 64))


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread every bit of a number over all 64."""
    values = (values ^ (values >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> U64(33))


def letter_values() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64) * STEP)


def powers(length: int) -> np.ndarray:
    found = np.full(length, STEP)
    found[:1] = 1
    return np.multiply.accumulate(found)


def letters_of(words: list[bytes], length: int) -> np.ndarray:
    return np.frombuffer(b"".join(words), np.uint8).reshape(-1, length)


def word_codes(letters: np.ndarray) -> np.ndarray:
    """The words as polynomials modulo 2^64."""
    return (letter_values()[letters] * powers(letters.shape[1])).sum(axis=1, dtype=np.uint64)


def bits_of(hashes: np.ndarray) -> np.ndarray:
    """The bits that a hash sets in its block."""
    mask = np.zeros(len(hashes), np.uint64)
    for i in range(BITS_SET):
        mask |= U64(1) << ((hashes >> U64(6 * i)) & U64(63))
    return mask


def block_of(hashes: np.ndarray, blocks: int) -> np.ndarray:
    return ((hashes >> U64(32)) * U64(blocks)) >> U64(32)


def part_of(codes: np.ndarray, parts: int) -> np.ndarray:
    """The pass that a code belongs to; independent of its block."""
    return mixed(codes ^ STEP) % U64(parts)


class Shard:
    """Bloom filter of the words of one length."""

    def __init__(self, words: int) -> None:
        self.blocks = np.zeros(-(-words * BITS_PER_WORD // 64) or 1, np.uint64)

    def holds(self, codes: np.ndarray) -> np.ndarray:
        hashes = mixed(codes)
        bits = bits_of(hashes)
        return self.blocks[block_of(hashes, len(self.blocks))] & bits == bits


def by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places in the list, letters) for every length."""
    raw = [w.encode("latin-1") for w in words]
    length = np.array([len(w) for w in raw])
    for n in np.unique(length):
        places = np.flatnonzero(length == n)
        yield int(n), places, letters_of([raw[i] for i in places], int(n))


def coded(words: DataFrame) -> DataFrame:
    """(word, n, length, code)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length, codes = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.uint64)
            for n, places, letters in by_length(batch.column(0).to_pylist()):
                length[places], codes[places] = n, word_codes(letters)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(length), pa.array(codes.view(np.int64))],
                names=["word", "n", "length", "code"])

    return map_batches(words, work, "word string, n bigint, length int, code bigint")


def filters(vocabulary: DataFrame, sizes: dict[int, int], part: int, parts: int) -> dict[int, Shard]:
    """The shards of one pass; bits are combined by block before they reach the driver."""
    shards = {length: Shard(-(-n // parts)) for length, n in sizes.items()}
    room = {length: len(shard.blocks) for length, shard in shards.items()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(1).to_numpy().view(np.uint64)
            mine = np.flatnonzero(part_of(codes, parts) == part)
            length, hashes = batch.column(0).to_numpy()[mine], mixed(codes[mine])
            blocks = np.zeros(len(mine), np.int64)
            for n in np.unique(length):
                some = length == n
                blocks[some] = block_of(hashes[some], room[int(n)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(length, pa.int32()), pa.array(blocks), pa.array(bits_of(hashes).view(np.int64))],
                names=["length", "block", "bits"])

    bits = map_batches(vocabulary.select("length", "code"), work, "length int, block bigint, bits bigint")
    found = bits.groupBy("length", "block").agg(F.bit_or("bits").alias("bits")).toArrow()
    length, block = found["length"].to_numpy(), found["block"].to_numpy()
    words = found["bits"].to_numpy().view(np.uint64)
    for n, shard in shards.items():
        some = length == n
        shard.blocks[block[some]] = words[some]
    return shards


# --- edits ----------------------------------------------------------------------------


def deletions(letters: np.ndarray, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, code) of every word with one letter less; of a run of one letter the first goes."""
    n, length = letters.shape
    values, power = letter_values(), powers(length)
    step = max(1, PROBES // n)
    ahead = np.zeros(n, np.uint64)  # code of the letters before ``start``
    for start in range(0, length, step):
        part = letters[:, start : start + step]
        terms = values[part] * power[start : start + step]
        sums = ahead[:, None] + np.add.accumulate(terms, axis=1, dtype=np.uint64)
        shorter = sums - terms + (codes[:, None] - sums) * INVERSE
        before = np.concatenate([letters[:, start - 1 : start] if start else np.zeros((n, 1), np.uint8), part[:, :-1]], axis=1)
        word, at = np.nonzero(part != before)
        yield word, shorter[word, at]
        ahead = sums[:, -1]


def replacements(letters: np.ndarray, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, code) of every word with one letter replaced by a later one."""
    n, length = letters.shape
    alphabet = np.frombuffer(LETTERS, np.uint8)
    values, power = letter_values(), powers(length)
    step = max(1, PROBES // (n * len(alphabet)))
    for start in range(0, length, step):
        part = letters[:, start : start + step]
        word, at, new = np.nonzero(alphabet[None, None, :] > part[:, :, None])
        change = (values[alphabet[new]] - values[part[word, at]]) * power[start + at]
        yield word, codes[word] + change


def positives(vocabulary: DataFrame, shards: Broadcast, part: int, parts: int) -> DataFrame:
    """(code, edited): edits of a word that its pass's filters hold."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shards.value
        for batch in batches:
            words = batch.column(0).to_pylist()
            for at in range(0, len(words), PROBES // 256):
                for length, _, letters in by_length(words[at : at + PROBES // 256]):
                    codes = word_codes(letters)
                    for shard, edits in ((known.get(length - 1), deletions), (known.get(length), replacements)):
                        for word, edited in edits(letters, codes) if shard is not None else ():
                            if parts > 1:
                                mine = part_of(edited, parts) == part
                                word, edited = word[mine], edited[mine]
                            hit = shard.holds(edited)
                            if hit.any():
                                yield pa.RecordBatch.from_arrays(
                                    [pa.array(codes[word[hit]].view(np.int64)), pa.array(edited[hit].view(np.int64))],
                                    names=["code", "edited"])

    return map_batches(vocabulary.select("word"), work, "code bigint, edited bigint")


def near_words(vocabulary: DataFrame, filter_blocks: int = FILTER_BLOCKS) -> DataFrame:
    """(word, n, other, other_n), both ways, of words one edit apart.

    ``vocabulary`` is what ``coded`` returns, stored.
    """
    spark = vocabulary.sparkSession
    sizes = {r["length"]: r["words"] for r in vocabulary.groupBy("length").agg(F.count("*").alias("words")).collect()}
    parts = max(1, -(-sum(sizes.values()) * BITS_PER_WORD // (64 * filter_blocks)))
    passes = []
    for part in range(parts):
        shards = spark.sparkContext.broadcast(filters(vocabulary, sizes, part, parts))
        found = positives(vocabulary, shards, part, parts)
        other = vocabulary.select(F.col("code").alias("edited"), F.col("word").alias("other"), F.col("n").alias("other_n"))
        exact = found.join(other, "edited").join(vocabulary.select("code", "word", "n"), "code").filter(
            F.levenshtein("word", "other", 1) == 1)
        passes.append(materialize(exact.select("word", "n", "other", "other_n").distinct(), "spelling-near"))
        shards.destroy()
    one_way = reduce(DataFrame.unionByName, passes)
    return one_way.unionByName(one_way.select(
        F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))


# --- forms and roots ------------------------------------------------------------------


def with_roots(forms: DataFrame) -> DataFrame:
    """Adds ``root`` to (word, form, ...): from the words without a form down, level by level.

    A word is joined with the few words that name it as their form, once.
    """
    found = [materialize(forms.filter(F.col("form").isNull()).withColumn("root", F.col("word")), "spelling-roots")]
    below = forms.filter(F.col("form").isNotNull())
    while True:
        above = found[-1].select(F.col("word").alias("form"), "root")
        level = materialize(below.join(above, "form").select(*forms.columns, "root"), "spelling-roots")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, found)
        found.append(level)


def spelling_variants(
    docs: DataFrame, every: int = DELETE_EVERY, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
    ratio: int = FORM_RATIO, filter_blocks: int = FILTER_BLOCKS,
) -> DataFrame:
    """word, form, root, n, n_near and form_n of every frequent word.

    A word's form is the most frequent word one edit away (ties: the first in code-point
    order) if it is at least ``ratio`` times as frequent; its root is the last of its forms.
    """
    counted = word_counts(docs, every, least_length).filter(F.col("n") >= least_count)
    vocabulary = materialize(coded(counted), "spelling-words")
    order = F.struct(-F.col("other_n"), F.col("other"))
    best = near_words(vocabulary, filter_blocks).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min_by(F.struct("other", "other_n"), order).alias("best"))
    strong = F.col("best.other_n") >= ratio * F.col("n")
    forms = materialize(
        vocabulary.select("word", "n").join(best, "word", "left").select(
            "word", F.when(strong, F.col("best.other")).alias("form"), "n",
            F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(strong, F.col("best.other_n")).alias("form_n")),
        "spelling-forms")
    return with_roots(forms).select("word", "form", "root", "n", "n_near", "form_n")
