"""Winnowed document fingerprints, with DataFrame functions only.

A text's words (cut into runs of at most ``LONGEST_WORD`` characters, so that text without
blanks is cut too) give rolling hashes of ``GRAM`` words.  Of every window of ``WINDOW``
hashes the least is chosen, the rightmost on ties, and kept with its position.  Two texts
that share ``GRAM + WINDOW - 1`` words in a row therefore share a chosen hash, and one with
the same place inside the shared run.

Null texts count as empty and have no fingerprint; texts shorter than a gram are one gram,
shorter than a window one window.  Two empty fingerprints are alike (1), an empty and another
one are not (0).  The document after the last one is the first; documents without an id come
last, rows that repeat an id follow one another by their text's hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmetrics.llm.common import id_and_text

GRAM = 4
WINDOW = 8
LONGEST_WORD = 24
POSITION_BITS = 24  # positions are kept modulo 2 ** POSITION_BITS
BLOCK_ROWS = 1024
MOST_BLOCKS = 1 << 14

WORD = rf"([^\x20\x09-\x0D]{{1,{LONGEST_WORD}}})"
_LAST = (1 << POSITION_BITS) - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def gram_keys(words: Column) -> Column:
    """A sortable number per gram: 39 bits of its hash, then the position from the right."""
    grams = F.greatest(F.size(words) - GRAM + 1, F.least(F.size(words), F.lit(1)))
    hashed = F.transform(
        F.when(grams > 0, F.sequence(F.lit(1), grams)).otherwise(F.array().cast("array<int>")),
        lambda i: F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.slice(words, i, GRAM)), 64 - 39), POSITION_BITS)
        + (F.lit(_LAST) - (i - 1).cast("bigint").bitwiseAND(F.lit(_LAST))),
    )
    return hashed


def chosen_keys(keys: Column) -> Column:
    """The least key of every window, each once, in order of position."""
    windows = F.greatest(F.size(keys) - WINDOW + 1, F.least(F.size(keys), F.lit(1)))
    least = F.transform(
        F.when(windows > 0, F.sequence(F.lit(1), windows)).otherwise(F.array().cast("array<int>")),
        lambda i: F.array_min(F.slice(keys, i, WINDOW)))
    return F.array_distinct(least)


def fingerprint(text: Column) -> Column:
    """Chosen keys of a text, as an array of numbers."""
    words = F.regexp_extract_all(text, F.lit(WORD), 1)
    return let(words, lambda w: let(gram_keys(w), chosen_keys))


def hash_of(key: Column) -> Column:
    return F.shiftrightunsigned(key, POSITION_BITS)


def position_of(key: Column) -> Column:
    return F.lit(_LAST) - key.bitwiseAND(F.lit(_LAST))


def as_text(keys: Column) -> Column:
    """hash@position, blank-separated."""
    return F.array_join(F.transform(keys, lambda k: F.concat(
        F.lpad(F.lower(F.hex(hash_of(k))), 10, "0"), F.lit("@"), position_of(k).cast("string"))), " ")


def likeness(left: Column, right: Column) -> Column:
    """Shared part of all chosen hashes of two fingerprints, 0 to 1."""
    return let(F.transform(left, hash_of), lambda a: let(F.transform(right, hash_of), lambda b: let(
        F.size(F.array_union(a, b)), lambda n: F.when(n == 0, F.lit(1.0)).otherwise(
            F.size(F.array_intersect(a, b)) / F.greatest(n, F.lit(1))))))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint (hash and position) of each row."""
    keys = fingerprint(F.col("text"))
    return id_and_text(docs).select("doc_id", keys.alias("keys")).select(
        "doc_id", F.transform("keys", lambda k: F.struct(
            hash_of(k).alias("hash"), position_of(k).alias("position"))).alias("fingerprint"))


def block_cuts(ids: DataFrame) -> tuple[list[int], int | None]:
    """Ids that are the largest of their block of about ``BLOCK_ROWS`` rows (all but the first block)."""
    found = ids.agg(F.count("doc_id").alias("n"), F.max("doc_id").alias("top")).first()
    blocks = min(-(-found["n"] // BLOCK_ROWS), MOST_BLOCKS)
    if blocks < 2:
        return [], found["top"]
    shares = [i / blocks for i in range(1, blocks)]
    cuts = ids.agg(F.percentile_approx("doc_id", shares, 20 * blocks).alias("cuts")).first()["cuts"]
    return sorted(set(cuts) - {found["top"]}), found["top"]


def block_number(doc_id: Column, cuts: list[int]) -> Column:
    """Blocks run from the largest ids (0) to the smallest; a cut id starts its block."""
    if not cuts:
        return F.lit(0)
    wide = max(int(len(cuts) ** 0.5), 1)
    groups = [cuts[i : i + wide] for i in range(0, len(cuts), wide)]
    tops = F.array(*[F.lit(g[-1]).cast("bigint") for g in groups])
    nested = F.array(*[F.array(*[F.lit(c).cast("bigint") for c in g]) for g in groups])
    sizes = F.array(*[F.lit(len(cuts) - i) for i in range(0, len(cuts), wide)])
    # Cuts at or above the id: those of later groups, and some of the group that it falls in.
    below = F.size(F.filter(tops, lambda t: t < doc_id))
    inside = F.size(F.filter(F.get(nested, below), lambda c: c < doc_id))
    return F.when(doc_id.isNull(), len(cuts)).when(below >= len(groups), 0).otherwise(F.get(sizes, below) - inside)


def with_next_text(docs: DataFrame) -> DataFrame:
    """Rows in descending doc_id with their block, order and whether they stand in for a neighbour.

    The rows are dealt into blocks of neighbouring ids; the first row of each block is given
    to the block before as well (and the very first to the last block), so that every row
    finds its successor in its own block.
    """
    rows = id_and_text(docs)
    cuts, top = block_cuts(rows.select("doc_id"))
    block = block_number(F.col("doc_id"), cuts)
    first_of = F.when(F.col("doc_id") == F.lit(top), F.lit(len(cuts)))
    if cuts:
        is_cut = F.array_contains(F.array(*[F.lit(c).cast("bigint") for c in cuts]), F.col("doc_id"))
        first_of = first_of.when(is_cut, F.col("block") - 1)
    if top is None:  # no ids at all: one block, led by its least hash
        least = rows.agg(F.min(F.xxhash64("text")).alias("h")).first()["h"]
        first_of = F.when(F.xxhash64("text") == F.lit(least), F.lit(0))
    places = F.filter(F.array(
        F.struct(F.col("block").alias("block"), F.lit(False).alias("stand_in")),
        F.when(first_of.isNotNull(), F.struct(first_of.alias("block"), F.lit(True).alias("stand_in"))),
    ), lambda p: p.isNotNull())
    return rows.withColumn("block", block).select(
        "doc_id", "text", F.xxhash64("text").alias("text_hash"), F.explode(places).alias("place")
    ).select("doc_id", "text", "text_hash", "place.block", "place.stand_in")


def edited_documents(docs: DataFrame) -> DataFrame:
    """Each row with its fingerprint, that of its edited text, and how alike they are.

    The edit replaces the last half of the characters by as many (or all) leading ones of
    the next document in descending doc_id.
    """
    order = Window.partitionBy("block").orderBy("stand_in", F.col("doc_id").desc_nulls_last(), "text_hash")
    n = F.char_length("text")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    follower = F.coalesce(F.lead("text").over(order), F.lit(""))
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half),
        F.substring(F.col("follower"), F.lit(1), half))
    made = (
        with_next_text(docs)
        .withColumn("follower", follower)
        .withColumn("n_chars", n.cast("bigint"))
        .select("*", edited.alias("edited"))
        .select("doc_id", "block", "stand_in", "text_hash", "n_chars",
                F.sha2("edited", 256).alias("edited_sha256"),
                fingerprint(F.col("text")).alias("keys"), fingerprint(F.col("edited")).alias("edited_keys"))
    )
    empty = F.array().cast("array<bigint>")
    return (
        made.withColumn("next_keys", F.coalesce(F.lead("keys").over(order), empty))
        .filter(~F.col("stand_in"))
        .select(
            "doc_id", "n_chars", "edited_sha256", as_text(F.col("keys")).alias("fingerprint"),
            as_text(F.col("edited_keys")).alias("edited_fingerprint"),
            likeness(F.col("keys"), F.col("edited_keys")).alias("near_edited"),
            likeness(F.col("keys"), F.col("next_keys")).alias("near_next"))
    )
