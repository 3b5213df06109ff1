"""Best stored path for each tool sequence.

Distinct sequences and paths are cut into blocks of bounded size, and each pair of
blocks is one task that emits only the best path of every sequence in it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmetrics.session import materialize

BLOCK_ROWS = 1024
BEST_DDL = "tool_sequence array<string>, at bigint, score double"


def _encode(sequences: list, book: dict[str, int], width: int, filler: int) -> np.ndarray:
    """The first ``width`` tools of every sequence as codes, one row per position."""
    codes = np.full((width, len(sequences)), filler, dtype="int32")
    for i, seq in enumerate(sequences):
        known = [book.setdefault(t, len(book)) for t in seq[:width]]
        codes[: len(known), i] = known
    return codes


def best_of(sequences: list, paths: list, over: str = "shortest") -> tuple[np.ndarray, np.ndarray]:
    """Index and score of the best path of each sequence; ties go to the first path.

    Score = equal positions over the shorter (``over="longest"``: the longer) length, 0
    where that length is 0.
    """
    book: dict[str, int] = {}
    long_a, long_b = np.array([len(s) for s in sequences]), np.array([len(p) for p in paths])
    width = int(min(long_a.max(), long_b.max()))
    a, b = _encode(sequences, book, width, -1), _encode(paths, book, width, -2)
    hits = np.zeros((len(sequences), len(paths)), dtype="int32")
    for some, other in zip(a, b):
        hits += some[:, None] == other[None, :]
    length = (np.minimum if over == "shortest" else np.maximum).outer(long_a, long_b)
    scores = np.divide(hits, length, out=np.zeros(hits.shape), where=length > 0)
    at = scores.argmax(axis=1)
    return at, scores[np.arange(len(sequences)), at]


def best_paths(
    sequences: DataFrame, paths: DataFrame, over: str = "shortest", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(tool_sequence, at, score) for each distinct non-empty sequence; no path, no row.

    ``paths`` has ``at`` (its place in the order that settles ties) and
    ``tool_sequence``; ``over`` is the length that scores are taken over.
    """
    distinct = materialize(
        sequences.filter(F.size("tool_sequence") > 0).select("tool_sequence").distinct(), "distinct-sequences")
    left_blocks = -(-distinct.count() // block_rows) or 1
    right_blocks = -(-paths.count() // block_rows) or 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = distinct.withColumn("i", F.pmod(F.xxhash64("tool_sequence"), F.lit(left_blocks)).cast("int"))
    b = paths.select("at", "tool_sequence").withColumn(
        "j", F.pmod(F.xxhash64("at"), F.lit(right_blocks)).cast("int"))

    def score(some: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if some.empty or others.empty:
            return pd.DataFrame(columns=["tool_sequence", "at", "score"], dtype=object)
        others = others.sort_values("at")
        found, points = best_of(list(some["tool_sequence"]), list(others["tool_sequence"]), over)
        return pd.DataFrame({
            "tool_sequence": some["tool_sequence"], "at": others["at"].to_numpy()[found], "score": points,
        })

    per_block = (
        a.withColumn("j", every(right_blocks)).groupBy("i", "j")
        .cogroup(b.withColumn("i", every(left_blocks)).groupBy("i", "j"))
        .applyInPandas(score, BEST_DDL)
    )
    order = F.struct(-F.col("score"), F.col("at"))
    return per_block.groupBy("tool_sequence").agg(F.min_by(F.struct("at", "score"), order).alias("r")).select(
        "tool_sequence", "r.*")
