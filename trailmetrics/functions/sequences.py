"""Expressions over tool sequences (arrays of tool names)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse_repeats(seq: Column) -> Column:
    """Drop an element equal to the one before it."""
    return F.filter(seq, lambda x, i: (i == 0) | (x != F.get(seq, i - 1)))


def is_subsequence(path: Column, seq: Column) -> Column:
    """True where the elements of ``path`` occur in ``seq`` in order.

    Walks ``seq`` once, keeping the number of path elements matched so far.
    """
    matched = F.aggregate(
        seq, F.lit(0), lambda done, x: F.when(F.get(path, done) == x, done + 1).otherwise(done)
    )
    return matched == F.size(path)


def positional_matches(a: Column, b: Column) -> Column:
    """Number of positions where both sequences hold the same element."""
    return F.size(
        F.filter(F.zip_with(a, b, lambda x, y: x.isNotNull() & (x == y)), lambda hit: hit)
    )


def conformance_to_longest(a: Column, b: Column) -> Column:
    """Matches over the longer length; NULL when both are empty."""
    longest = F.greatest(F.size(a), F.size(b))
    return positional_matches(a, b) / F.nullif(longest, F.lit(0))


def alignment(seq: Column, optimal: Column) -> Column:
    """Per step: match, deviation, or extra beyond the optimal length."""
    return F.transform(
        seq,
        lambda x, i: F.when(i >= F.size(optimal), "extra")
        .when(x == F.get(optimal, i), "match")
        .otherwise("deviation"),
    )


def suffix_after(seq: Column, length: Column) -> Column:
    """Elements after the first ``length`` ones."""
    return F.filter(seq, lambda _, i: i >= length)


def same_tools_other_order(seq: Column, optimal: Column) -> Column:
    """Same set of tools, different sequence."""
    return (
        F.array_sort(F.array_distinct(seq)) == F.array_sort(F.array_distinct(optimal))
    ) & (seq != optimal)


def has_loop(window: Column, threshold: int) -> Column:
    """Some element occurs at least ``threshold`` times in the window array."""
    counts = F.transform(
        F.array_distinct(window), lambda x: F.size(F.filter(window, lambda y: y == x))
    )
    return F.coalesce(F.array_max(counts), F.lit(0)) >= threshold


def as_symbols(seq: Column, dictionary: Column) -> Column:
    """Encode a sequence as a string, one character per distinct tool.

    ``dictionary`` is an array of tool names; the position of a tool picks its
    character, so the built-in ``levenshtein`` measures edits of whole tools.
    Characters start above the basic plane, which leaves room for a million tools.
    """
    before_first = 0xFFFF
    return F.array_join(
        F.transform(
            seq,
            lambda t: F.decode(
                F.unhex(F.lpad(F.hex(F.array_position(dictionary, t) + before_first), 8, "0")), "UTF-32"
            ),
        ),
        "",
    )


def normalised_edit_distance(a: Column, b: Column) -> Column:
    """2 * edits / (len a + len b) of two encoded sequences; both empty -> 0."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 0.0).otherwise(
        2.0 * F.levenshtein(a, b) / F.nullif(total, F.lit(0))
    )
