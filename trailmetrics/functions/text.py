"""Text expressions: names, labels, number formats and the guidance block."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers that open and close a guidance block, in priority order.
BLOCK_OPENERS = (
    "OPTIMIZATION HINT —",
    "OPTIMIZATION HINT:",
    "RECOMMENDED PATH:",
    "IMPORTANT — VALIDATED OPTIMAL PATH:",
    "VALIDATED PATHS for this task type:",
)
BLOCK_CLOSERS = ("</context>", "\n\nYou are", "\n\n---")
VARIANT_SUFFIX = r"^(.+?)\s*\(subcluster_(\d+)\)$"


def humanise(name: Column) -> Column:
    """``check_order`` -> ``Check order``."""
    words = F.replace(name, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.lower(F.substr(words, F.lit(2))))


def title_case(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def truncate(text: Column, length: int, ellipsis: str = "") -> Column:
    head = F.substring(text, 1, length)
    if not ellipsis:
        return head
    return F.when(F.length(text) > length, F.concat(head, F.lit(ellipsis))).otherwise(text)


def parent_group(cluster: Column) -> Column:
    """Name before `` (subcluster_n)``; the whole name where there is no suffix."""
    parent = F.trim(F.regexp_extract(cluster, VARIANT_SUFFIX, 1))
    return F.when(cluster.rlike(VARIANT_SUFFIX), parent).otherwise(cluster)


def is_variant(cluster: Column) -> Column:
    return cluster.rlike(VARIANT_SUFFIX)


def variant_label(cluster: Column) -> Column:
    """``Variant n+1`` for a sub-cluster name, else the name itself."""
    number = F.regexp_extract(cluster, VARIANT_SUFFIX, 2)
    return F.when(
        is_variant(cluster),
        F.concat(F.lit("Variant "), F.nullif(number, F.lit("")).cast("int") + 1),
    ).otherwise(cluster)


def variant_display_name(cluster: Column, description: Column) -> Column:
    return F.coalesce(F.nullif(description, F.lit("")), variant_label(cluster))


def in_group(cluster: Column, group: str) -> Column:
    """The group's own row or one of its sub-cluster rows."""
    return (cluster == group) | (
        cluster.startswith(group + " (subcluster_") & cluster.endswith(")")
    )


def numbered(items: Column, first: int | Column = 1, indent: str = "  ") -> Column:
    """Numbered lines, one per item."""
    start = F.lit(first) if isinstance(first, int) else first
    return F.array_join(
        F.transform(items, lambda x, i: F.concat(F.lit(indent), i + start, F.lit(". "), x)), "\n"
    )


def format_duration(ms: Column) -> Column:
    return (
        F.when(ms.isNull(), "-")
        .when(ms < 1000, F.concat(F.floor(ms + 0.5), F.lit("ms")))
        .otherwise(F.concat(F.format_string("%.1f", ms / 1000), F.lit("s")))
    )


def format_percent(share: Column) -> Column:
    return F.when(share.isNull(), "-").otherwise(
        F.concat(F.format_string("%.1f", share * 100), F.lit("%"))
    )


def format_cost(usd: Column) -> Column:
    return (
        F.when(usd.isNull(), "-")
        .when(usd < 0.01, F.concat(F.lit("$"), F.format_string("%.4f", usd)))
        .otherwise(F.concat(F.lit("$"), F.format_string("%.2f", usd)))
    )


def format_count(n: Column) -> Column:
    """Thousands separators for whole numbers, one decimal otherwise."""
    return (
        F.when(n.isNull(), "-")
        .when(n == F.floor(n), F.format_number(n, 0))
        .otherwise(F.format_string("%.1f", n))
    )


def format_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "dd MMM, HH:mm")


def guidance_block(prompt: Column) -> Column:
    """The guidance part of a prompt: first opener present (by priority) up to the
    nearest closer after it, trimmed; NULL where no opener occurs."""
    openings = [F.nullif(F.instr(prompt, m), F.lit(0)) for m in BLOCK_OPENERS]
    begin = F.coalesce(*openings)
    rest = F.substr(prompt, begin)
    closings = [F.nullif(F.instr(rest, m), F.lit(0)) for m in BLOCK_CLOSERS]
    end = F.coalesce(F.least(*closings), F.length(rest) + 1)
    return F.regexp_replace(F.substr(rest, F.lit(1), end - 1), r"^\s+|\s+$", "")
