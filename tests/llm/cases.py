"""Awkward inputs that every operator must take."""

from __future__ import annotations

LONG = " ".join(f"word{i * 7919 % 5003}" for i in range(30_000))
PROSE = ("Release notes come first. This text stands under the MIT License and says so at length, so that it is longer "
         "than one hundred bytes and can repeat.")
DDL = "size string, doc_id bigint, text string, lang string, source string, n_chars bigint, target int, row int, one int"


def documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    texts = [
        (1, PROSE, "en", "a"), (2, PROSE, "en", "a"), (3, PROSE + " Changed.", "en", None), (4, None, None, None),
        (5, "", "en", "b"), (6, "  \n\t ", None, "b"), (7, "one", "en", "b"), (8, "one two", "de", "c"),
        (9, LONG, "en", "a"), (10, "x" * 5000, "en", "c"), (11, "été où ß Σ 日本語 " * 30, "fr", "é"), (12, "12 34 !!", "en", "c"),
        (13, LONG + " end", "en", "a"), (None, PROSE, "en", "b"), (None, None, None, None), (7, "one", "en", "b"),
        (14, "a" * 300, "en", "c"), (15, PROSE + "\n" + PROSE, "en", "a"),
    ]
    rows = [("x", i, t, lang, s, None if t is None else len(t), 1, 2, 3) for i, t, lang, s in texts]
    return spark.createDataFrame(rows, DDL).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DDL)


def plain(docs) -> list[tuple[int | None, str]]:
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
