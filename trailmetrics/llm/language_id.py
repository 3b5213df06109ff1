"""Language identification by error-correcting output codes over character n-grams.

Every learned language gets a codeword of +1/-1 bits.  For each bit a binary n-gram
classifier tells the languages with +1 from those with -1: its weight of a hashed n-gram is
the log ratio of the n-gram's smoothed share in the two sides, each side being the mean of
its languages.  All labelled rows count: n-gram counts per language are summed by Spark, and
only the (language, bucket) totals, ``BUCKETS`` numbers a language, reach the driver.

A text's margin at a bit is its mean n-gram weight, scaled by what the learned languages
show there.  Decoding adds up the logistic loss of the margins against every codeword, bits
weighted by how far they part the languages, and chooses the language of least loss.  A
small lead over the second best flags the answer as ambiguous.

Texts that are null or without a letter get ``und`` with score 0.  Without labelled rows
every text gets ``und``; with one language every other text gets that language.  Rows that
repeat are predicted alike; a null doc_id counts as the text of an empty id when rows are
held out.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmetrics.llm.common import map_batches

BUCKETS = 1 << 14
LONGEST = 3
PIECE = 1 << 18  # characters of a text that are hashed at once
LEAST_BITS = 15
ROWS_AT_ONCE = 64
AMBIGUOUS = 0.1
UNKNOWN = "und"

LETTER = re.compile(r"[^\W\d_]")
_FACTORS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], dtype=np.uint64)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: CRC-32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


@cache
def _letters() -> str:
    """LETTER as a Java class of code points: Java's own tables may know fewer letters (Java 17 lacks those since Unicode 14)."""
    every = "".join(map(chr, range(sys.maxunicode + 1)))
    runs = re.finditer(f"{LETTER.pattern}+", every)
    return "[" + "".join(f"\\x{{{m.start():x}}}-\\x{{{m.end() - 1:x}}}" for m in runs) + "]"


def has_letter(text: Column) -> Column:
    """Whether a text can be predicted at all, whatever the model; false for null."""
    text = text.cast("string")
    return F.coalesce(text.rlike("[A-Za-z]") | text.rlike(_letters()), F.lit(False))  # the short class answers for most


def _buckets(codes: np.ndarray) -> np.ndarray:
    """Buckets of all 1-, 2- and 3-grams of a row of code points."""
    parts = []
    h = np.zeros(len(codes), np.uint64)
    for n in range(LONGEST):
        if len(codes) <= n:
            break
        h = (h[: len(codes) - n] + codes[n:]) * _FACTORS[n] & np.uint64(0xFFFFFFFF)
        parts.append(((h ^ (h >> np.uint64(15))) * np.uint64(0x2C1B3C6D) >> np.uint64(12)) % np.uint64(BUCKETS))
    return np.concatenate(parts).astype(np.int64)


def ngram_counts(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of the whole lower-case text.

    Digits and runs of other signs count as one space: they tell no language.
    """
    plain = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = (plain > 127) | ((plain >= 97) & (plain <= 122))
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    codes = np.where(letter, plain, 32)[keep].astype(np.uint64)
    counts = np.zeros(BUCKETS, np.int64)
    for start in range(0, len(codes), PIECE):
        counts += np.bincount(_buckets(codes[start : start + PIECE + LONGEST - 1]), minlength=BUCKETS)
    return counts


def language_counts(labelled: DataFrame) -> DataFrame:
    """(lang, bucket, n) summed over all labelled rows (lang, text)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lang not in totals:
                    totals[lang] = np.zeros(BUCKETS, np.int64)
                totals[lang] += ngram_counts(text)
        for lang, counts in totals.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(used), pa.string()), pa.array(used), pa.array(counts[used])],
                names=["lang", "bucket", "n"])

    return map_batches(labelled, work, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(
        F.sum("n").alias("n"))


def codewords(languages: int) -> np.ndarray:
    """Rows of +1/-1 with a large least distance: the best of seeded random draws.

    No bit is constant, and for few languages all different bits are used.
    """
    if languages < 2:
        return np.ones((languages, 0), np.int8)
    if languages <= 5:
        bits = np.array([[1 if i == 0 or b >> (i - 1) & 1 else -1 for b in range(2 ** (languages - 1) - 1)]
                         for i in range(languages)], np.int8)
        return bits
    width = max(LEAST_BITS, 10 * int(np.ceil(np.log2(languages))))
    rng = np.random.Generator(np.random.PCG64(7))
    best, best_distance = None, -1
    for _ in range(200):
        draw = rng.choice(np.array([-1, 1], np.int8), (languages, width))
        if (np.abs(draw.sum(axis=0)) == languages).any():
            continue
        same = draw.astype(np.int64) @ draw.T.astype(np.int64)
        distance = int(((width - same) // 2 + width * np.eye(languages, dtype=np.int64)).min())
        if distance > best_distance:
            best, best_distance = draw, distance
    return best


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits, scaled
    bit_weight: np.ndarray

    def losses(self, counts: np.ndarray) -> np.ndarray:
        """Weighted logistic loss of each codeword, texts x languages."""
        shares = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        margins = (shares @ self.weights)[:, None, :] * self.code[None, :, :]
        return (np.log1p(np.exp(-4 * margins)) * self.bit_weight).sum(axis=2)


def fit(docs: DataFrame) -> Model:
    """Learn from (lang, text) of rows that have both."""
    labelled = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counted = language_counts(labelled.filter("lang is not null and text is not null")).collect()
    languages = sorted({row["lang"] for row in counted})
    at = {lang: i for i, lang in enumerate(languages)}
    counts = np.zeros((len(languages), BUCKETS))
    for row in counted:
        counts[at[row["lang"]], row["bucket"]] = row["n"]
    code = codewords(len(languages))
    share = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
    weights = np.zeros((BUCKETS, code.shape[1]))
    bit_weight = np.zeros(code.shape[1])
    for b in range(code.shape[1]):
        positive = code[:, b] > 0
        weights[:, b] = np.log(share[positive].mean(axis=0)) - np.log(share[~positive].mean(axis=0))
        shown = code[:, b] * (share @ weights[:, b])  # what each language shows of its own bit
        weights[:, b] /= max(float(shown.mean()), 1e-9)
        bit_weight[b] = max(float(shown.min()), 1e-3)
    total = bit_weight.sum()
    return Model(languages, code, weights, bit_weight / total if total else bit_weight)


PREDICTIONS = "lang_pred string, score double, ambiguous boolean"


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
    names, scores, unsure = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
    asked = [i for i, t in enumerate(texts) if t is not None and model.languages and LETTER.search(t)]
    for start in range(0, len(asked), ROWS_AT_ONCE):
        part = asked[start : start + ROWS_AT_ONCE]
        losses = model.losses(np.stack([ngram_counts(texts[i]) for i in part]))
        chance = np.exp(-8 * (losses - losses.min(axis=1, keepdims=True)))
        chance /= chance.sum(axis=1, keepdims=True)
        order = np.argsort(losses, axis=1, kind="stable")
        for row, i in enumerate(part):
            best = order[row, 0]
            names[i], scores[i] = model.languages[best], float(chance[row, best])
            second = chance[row, order[row, 1]] if len(model.languages) > 1 else 0.0
            unsure[i] = bool(chance[row, best] - second < AMBIGUOUS)
    return names, scores, unsure


def identify(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` with lang_pred, score and ambiguous appended (replacing such columns)."""
    added = ["lang_pred", "score", "ambiguous"]
    kept = docs.drop(*added)
    place = kept.columns.index(text_column)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, unsure = predict(model, batch.column(place).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(unsure)],
                names=[*batch.schema.names, *added])

    return map_batches(kept, work, f"{fields}, {PREDICTIONS}")


def language_ids(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of every row.

    Learns from the rows that are not held out; lang, source and doc_id are no inputs of a
    prediction.
    """
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
        F.col("text").cast("string").alias("text"))
    return identify(rows, model).drop("text")
