"""Pages deep inside an order, without sorting all rows up to them in one task.

Rows are cut into ranges of the order; counting the ranges tells which of them hold the page,
and only those are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmetrics.session import materialize


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of ``rows`` in ``order``, which must be unique.

    The ranges are stored, because their bounds are sampled.  The driver sees one count per
    range, as many as shuffle partitions.
    """
    if limit < 1 or offset < 0:
        raise ValueError("limit must be positive and offset must not be negative")
    ranges = materialize(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "page-ranges")
    ahead, skipped, inside = 0, 0, []
    for number, n in sorted(tuple(r) for r in ranges.groupBy("_range").count().collect()):
        if ahead + n <= offset:
            skipped = ahead + n
        elif ahead < offset + limit:
            inside.append(number)
        ahead += n
    held = ranges.filter(F.col("_range").between(inside[0], inside[-1]) if inside else F.lit(False)).drop("_range")
    return held.orderBy(*order).offset(offset - skipped if inside else 0).limit(limit)
