"""URL filters over time: dated list entries joined as of each capture.

Entries say that a list (category) lists or unlists a pattern from a time on.  Per pattern and
list they become validity intervals [from, until): an entry that lists opens one, the next entry
of that list for the pattern ends it, and of its entries at one time an unlisting wins.  Lists do
not touch each other's entries.  Patterns are host names; a pattern
matches a capture whose host is the pattern or lies below it, so a capture is looked up under
each of its host's suffixes, as deep as the deepest listed pattern.

Intervals and captures are joined by pattern and calendar month, with the exact times as a
further condition, so neither a host with many captures nor a pattern with a long history
meets as a whole.  An interval stands under those of its months that have captures.  The longest active pattern gives the verdict; where several lists have it
active, the first category by name is reported, an unnamed one last.

Captures without a URL, host or fetch time, and entries without pattern or time, match nothing.
Host names are compared in lower case, without port, user and final dots; IPv6 addresses in
their brackets.  Rows that repeat a page_id are
joined and reported one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/?#:\[]+)"


def plain_name(name: Column) -> Column:
    """A host name in lower case, without the dots that may end it."""
    return F.rtrim(F.lower(name), F.lit("."))


def host_of(url: Column) -> Column:
    return plain_name(F.regexp_extract(url, HOST, 1))


def host_suffixes(host: Column, deepest: Column) -> Column:
    """The domains above the host and the host itself, of one to ``deepest`` labels.

    An address in brackets is looked up as a whole.
    """
    labels = F.when(host.startswith("["), F.array(host)).otherwise(F.split(host, r"\."))
    depth = F.least(F.size(labels), deepest)
    return F.transform(
        F.sequence(F.lit(1), depth),
        lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(pattern, category, valid_from, valid_until) from (pattern, category, listed, at)."""
    usable = entries.filter("pattern is not null and at is not null")
    # One entry per pattern, list and time: unlisting wins.
    settled = usable.groupBy(plain_name(F.col("pattern")).alias("pattern"), "category", "at").agg(
        F.min(F.coalesce("listed", F.lit(True))).alias("listed"))
    history = Window.partitionBy("pattern", "category").orderBy("at")
    return settled.withColumn("valid_until", F.lead("at").over(history)).filter("listed").select(
        "pattern", "category", F.col("at").alias("valid_from"), "valid_until")


def month(at: Column) -> Column:
    return (F.year(at) * 12 + F.month(at)).cast("int")


def verdicts(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, host, blocked, pattern, category, valid_from per capture (page_id, url, fetched_at)."""
    seen = captures.select(
        F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("bigint").alias("page_id"),
        host_of(F.col("url")).alias("host"), F.col("fetched_at").cast("timestamp").alias("fetched_at"))
    dated = seen.filter("host <> '' and fetched_at is not null").withColumn("month", month(F.col("fetched_at")))
    # One row; as long as there are calendar months with captures, however many captures there are.
    months = dated.agg(F.collect_set("month").alias("months"))
    ends = F.coalesce(month(F.col("valid_until")), F.lit((1 << 31) - 1))
    intervals = (
        validity_intervals(entries)
        .crossJoin(F.broadcast(months))
        .withColumn("from", month(F.col("valid_from"))).withColumn("to", ends)
        .withColumn("month", F.explode(F.filter("months", lambda m: m.between(F.col("from"), F.col("to")))))
        .drop("months", "from", "to")
    )
    deepest = entries.agg(F.max(F.size(F.split("pattern", r"\."))).alias("deepest")).filter("deepest > 0")
    asked = (
        dated.crossJoin(F.broadcast(deepest))  # one row, none without patterns
        .withColumn("pattern", F.explode(host_suffixes(F.col("host"), F.col("deepest"))))
        .drop("deepest")
    )
    active = (F.col("fetched_at") >= F.col("valid_from")) & (
        F.col("valid_until").isNull() | (F.col("fetched_at") < F.col("valid_until")))
    hits = (
        asked.join(intervals, ["pattern", "month"]).filter(active)
        .select("row", "page_id", "host", F.struct(
            (-F.length("pattern")).alias("order"), F.isnull("category").alias("unnamed"), "category", "pattern",
            "valid_from").alias("hit"))
    )
    nothing = F.lit(None).cast(hits.schema["hit"].dataType)
    every = seen.select("row", "page_id", "host", nothing.alias("hit")).union(hits)
    return every.groupBy("row", "page_id", "host").agg(F.min("hit").alias("hit")).select(
        "page_id", "host", F.col("hit").isNotNull().alias("blocked"), "hit.pattern", "hit.category", "hit.valid_from")
