"""Neighbour, rank and rolling operators that do not put one key in one task.

A plain window sends every row of a key to one task.  Here a key is cut into
blocks (step ranges, hours or range partitions); windows run inside a block, and only
a few small rows per block travel to join the blocks up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmetrics.session import materialize

STEP_BLOCK = 4096


def step_block(column: str = "step_number") -> Column:
    return F.floor(F.col(column) / STEP_BLOCK)


def hour_block(column: str = "timestamp") -> Column:
    """Hour of the timestamp as an orderable value, without a time-zone cast."""
    return F.unix_date(F.to_date(column)) * 24 + F.hour(column)


def with_next(
    rows: DataFrame, keys: list[str], block: Column, order: list[str], fields: list[str], direction: str = "next",
) -> DataFrame:
    """Add a struct column ``next`` (or ``previous``) with the neighbour's fields.

    Windows run inside blocks of a key.  The first (last) row of the nearest non-empty block of the same key is
    lent to a block as its end, so rows are dealt once and joined with nothing; a block borrows
    one row at most, keys of one block none.  Rows without a block come first, rows without a key
    are a key of their own.
    """
    packed = F.struct(*fields)
    shift, edge_of = (F.lead, F.min_by) if direction == "next" else (F.lag, F.max_by)
    blocked = rows.withColumn("_block", block)
    parts = [*keys, "_block"]
    lent = (
        blocked.groupBy(*parts)
        .agg(edge_of(packed, F.struct(*order)).alias("_edge"))
        .withColumn("_far", shift("_edge").over(Window.partitionBy(*keys).orderBy("_block")))
        .filter(F.col("_far").isNotNull())
        .select(*parts, "_far.*", F.lit(True).alias("_lent"))
    )
    ends = F.col("_lent").asc() if direction == "next" else F.col("_lent").desc()
    return (
        blocked.withColumn("_lent", F.lit(False)).unionByName(lent, allowMissingColumns=True)
        .withColumn(direction, shift(packed).over(Window.partitionBy(*parts).orderBy(ends, *order)))
        .filter(~F.col("_lent")).drop("_block", "_lent")
    )


def range_chunks(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Cut the rows, sorted by keys and order, into balanced ranges (``_chunk``).

    ``order`` must end in a unique column, so that even one single key is spread
    over all ranges.  The result is stored, because range bounds are sampled: two
    branches of one plan must not see two different cuts.
    """
    cut = rows.repartitionByRange(*keys, *order).withColumn("_chunk", F.spark_partition_id())
    return materialize(cut, "range-chunks")


def running_total(
    rows: DataFrame, keys: list[str], order: list[str], value: str, name: str
) -> DataFrame:
    """Sum of ``value`` over all earlier rows of the key (the row itself excluded)."""
    chunked = range_chunks(rows, keys, order)
    inside = (
        Window.partitionBy(*keys, "_chunk").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    partial = chunked.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    before = (
        Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ) if keys else Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        chunked.groupBy(*keys, "_chunk").agg(F.sum(value).alias("_sum"))
        .select(*keys, "_chunk", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_ahead"))
    )
    return (
        partial.join(offsets, [*keys, "_chunk"])
        .withColumn(name, F.col("_inside") + F.col("_ahead"))
        .drop("_inside", "_ahead", "_chunk")
    )


def with_borrowed_rows(
    blocked: DataFrame, keys: list[str], block: str, order: list[str], fields: list[str], width: int
) -> DataFrame:
    """Add the last ``width - 1`` rows before each block to that block (``own`` false).

    Only blocks with a later block of the same key lend rows, so ordinary keys with
    one block cost nothing; a block borrows at most ``width - 1`` rows.
    """
    n = width - 1
    used = list(dict.fromkeys([*order, *fields]))
    in_order = Window.partitionBy(*keys).orderBy(block)
    lenders = (
        blocked.select(*keys, block).distinct()
        .withColumn("_later", F.lead(block).over(in_order))
        .filter(F.col("_later").isNotNull())
        .select(*keys, block)
    )
    newest = Window.partitionBy(*keys, block).orderBy(*[F.desc(c) for c in order])
    tails = (
        blocked.join(lenders, [*keys, block], "left_semi")
        .withColumn("_back", F.row_number().over(newest))
        .filter(F.col("_back") <= n)
        .groupBy(*keys, block)
        .agg(F.collect_list(F.struct(*used)).alias("_tail"))
    )
    # Every lender gives at least one row, so the n blocks before are enough.
    receivers = blocked.select(*keys, block).distinct().join(
        lenders.select(*keys).distinct(), keys, "left_semi"
    )
    seen = F.flatten(F.collect_list("_tail").over(in_order.rowsBetween(-n, -1)))
    borrowed = (
        receivers.join(tails, [*keys, block], "left")
        .withColumn("_seen", seen)
        .select(*keys, block, F.explode(F.slice(F.reverse(F.array_sort("_seen")), 1, n)).alias("_row"))
        .select(*keys, block, *[F.col(f"_row.{c}").alias(c) for c in used])
        .withColumn("own", F.lit(False))
    )
    return blocked.withColumn("own", F.lit(True)).unionByName(borrowed, allowMissingColumns=True)


def trailing_mean(
    rows: DataFrame, keys: list[str], order: list[str], value: str, width: int, name: str
) -> DataFrame:
    """Mean of the last ``width`` values of the key up to the row (fewer at the start)."""
    chunked = range_chunks(rows, keys, order)
    together = with_borrowed_rows(chunked, keys, "_chunk", order, [value], width)
    frame = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(-(width - 1), 0)
    return together.withColumn(name, F.avg(value).over(frame)).filter("own").drop("own", "_chunk")
