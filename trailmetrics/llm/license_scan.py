"""License scans by diagonal voting, with DataFrame functions only.

Templates are word sequences: short phrases and opening words of license texts.  All rolling
word 2-grams of all documents are joined (hash, then the words themselves) with the templates'
2-gram positions.  Every hit votes for the diagonal "document position minus template
position": a template that stands at word s of a document collects its votes on diagonal s.

A phrase is found on a diagonal that has all its votes.  A text template allows inserted,
missing and changed words: neighbouring diagonals (at most ``DRIFT`` apart) are merged into
one span, and so are diagonals that follow one of ``STRONG`` votes within a bound that grows with
the template (a part in ``LONG_DRIFT`` of its length).  The span is verified by the share of the
template's 2-grams that it covers.

Null texts count as empty: no words, no label, score 0.  Every input row gives one result
row, also rows that repeat.  The template table is a fixed list, so its broadcast is bounded.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmetrics.llm.common import id_and_text

# The base phrases and their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
# Phrases and opening words of public licenses, with labels of this method.
FURTHER_PHRASES = [
    ("cc by nc", "cc-by-nc"),
    ("cc by sa", "cc-by-sa"),
    ("cc by nd", "cc-by-nd"),
    ("bsd license", "bsd"),
    ("mozilla public license", "mpl"),
    ("creative commons zero", "cc0"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
]
TEXTS = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and "
     "associated documentation files the software to deal in the software without restriction", "mit-text"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at",
     "apache-text"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu "
     "general public license as published by the free software foundation", "gpl-text"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided "
     "that the following conditions are met", "bsd-text"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is "
     "hereby granted", "isc-text"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl-text"),
    ("this is free and unencumbered software released into the public domain", "unlicense-text"),
    ("this work is licensed under a creative commons attribution", "cc-by-text"),
]

GRAM = 2
DRIFT = 2
LONG_DRIFT = 6
STRONG = 3
COVERED = 0.7
LONGEST_TEMPLATE = 62  # votes of a diagonal are bits of a number

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

Template = tuple[str, str, str]  # words, label, kind


def templates() -> list[Template]:
    return (
        [(words, label, "base") for words, label in PHRASES]
        + [(words, label, "phrase") for words, label in FURTHER_PHRASES]
        + [(words, label, "text") for words, label in TEXTS]
    )


def template_grams(spark: SparkSession, known: list[Template]) -> DataFrame:
    """(template, label, kind, grams, place, bit, t0, t1): the 2-gram positions of the templates."""
    rows = []
    for number, (text, label, kind) in enumerate(known):
        words = text.split()
        if not GRAM <= len(words) <= LONGEST_TEMPLATE:
            raise ValueError(f"a template has {GRAM} to {LONGEST_TEMPLATE} words: {text}")
        for place, (one, two) in enumerate(zip(words, words[1:])):
            rows.append(f"({number}, '{label}', '{kind}', {len(words) - 1}, {place}, {1 << place}L, '{one}', '{two}')")
    return spark.sql(
        f"SELECT * FROM VALUES {', '.join(rows)} AS t(template, label, kind, grams, place, bit, t0, t1)")


def rolling_grams(docs: DataFrame) -> DataFrame:
    """One row per 2-gram (and per empty text): row, doc_id, n_words, place, w0, w1; the last w1 is null."""
    text = F.translate("text", ascii_uppercase, ascii_lowercase)  # other letters stay as they are
    words = F.regexp_extract_all(text, F.lit(WORD), 0)
    return (
        id_and_text(docs)
        .select(F.monotonically_increasing_id().alias("row"), "doc_id", words.alias("words"))
        .select("row", "doc_id", F.size("words").alias("n_words"), "words",
                F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))).alias("after"))
        .select("row", "doc_id", "n_words", F.arrays_zip("words", "after").alias("pairs"))
        .select("row", "doc_id", "n_words", F.posexplode_outer("pairs").alias("at", "pair"))
        .select("row", "doc_id", "n_words", "at", F.col("pair.words").alias("w0"), F.col("pair.after").alias("w1"))
    )


def votes(docs: DataFrame, known: list[Template]) -> DataFrame:
    """(row, doc_id, n_words, template, ..., diagonal, mask) and one row without template per text.

    ``mask`` has a bit for every template place that was hit on the diagonal.
    """
    grams = F.broadcast(template_grams(docs.sparkSession, known).withColumn("hash", F.xxhash64("t0", "t1")))
    rolled = rolling_grams(docs)
    hit = (F.xxhash64(rolled.w0, rolled.w1) == grams.hash) & (rolled.w0 == grams.t0) & (rolled.w1 == grams.t1)
    return (
        rolled.join(grams, hit, "left")
        .filter("template is not null or at is null or at = 0")
        .groupBy("row", "doc_id", "n_words", "template", "label", "kind", "grams",
                 F.when(F.col("template").isNotNull(), F.col("at") - F.col("place")).alias("diagonal"))
        .agg(F.bit_or("bit").alias("mask"))
    )


def spans(voted: DataFrame) -> DataFrame:
    """Merge neighbouring diagonals of text templates and verify all spans (``covered``: 0 to 1)."""
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(along)
    strong = F.when(F.bit_count("mask") >= STRONG, F.col("diagonal"))
    before = F.last(strong, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    merged = (gap <= DRIFT) | (F.col("diagonal") - before <= F.floor(F.col("grams") / LONG_DRIFT))
    starts = ((F.col("kind") != "text") | ~F.coalesce(merged, F.lit(False))).cast("int")
    return (
        voted.withColumn("new", F.coalesce(starts, F.lit(1)))
        .withColumn("span", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("row", "doc_id", "n_words", "template", "label", "kind", "grams", "span")
        .agg(F.min("diagonal").alias("start"), F.bit_or("mask").alias("mask"))
        .withColumn("covered", F.bit_count("mask") / F.col("grams"))
        .withColumn("found", F.when(F.col("kind") == "text", F.col("covered") >= COVERED).otherwise(F.col("covered") == 1))
    )


def joined_labels(labels: Column) -> Column:
    return F.array_join(F.array_sort(labels), ",")


def scan(docs: DataFrame, known: list[Template] | None = None) -> DataFrame:
    """One row per document: counts, places and labels of the licenses found.

    ``score`` is the largest covered share of a template that was found, else 0.
    """
    base = F.col("found") & (F.col("kind") == "base")
    return (
        spans(votes(docs, known or templates()))
        .groupBy("row", "doc_id", F.col("n_words").cast("bigint").alias("n_words"))
        .agg(
            F.count_if(base).alias("n_base"),
            F.min(F.when(base, F.col("start"))).cast("bigint").alias("first_word"),
            F.max(F.when(base, F.col("start"))).cast("bigint").alias("last_word"),
            joined_labels(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"),
            joined_labels(F.collect_set(F.when(F.col("found"), F.col("label")))).alias("labels"),
            F.coalesce(F.max(F.when(F.col("found"), F.col("covered"))), F.lit(0.0)).alias("score"),
        )
        .drop("row")
    )
