"""Guided against exploration runs: Mann-Whitney U and Hedges' g."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmetrics.operators.events import terminal_with_mode
from trailmetrics.operators.ordering import running_total


def mode_significance(event_logs: DataFrame, value: str = "duration_ms") -> DataFrame:
    """U of the guided runs, its z score with tie correction, and Hedges' g.

    Runs are first counted per distinct value; the number of exploration runs below
    a value is a running total over value ranges, so no task sorts all runs.
    """
    runs = terminal_with_mode(event_logs).filter(F.col(value).isNotNull()).select(
        F.col(value).cast("double").alias("v"), "is_guided"
    )
    counts = runs.groupBy("v").agg(
        F.count(F.when(F.col("is_guided") == 1, 1)).alias("g"),
        F.count(F.when(F.col("is_guided") == 0, 1)).alias("e"),
    )
    ranked = running_total(counts, [], ["v"], "e", "below")
    g, e = F.col("g").cast("double"), F.col("e").cast("double")
    t = g + e
    totals = ranked.agg(
        F.sum(g * (F.col("below") + 0.5 * e)).alias("u"),
        F.sum(g).alias("n1"), F.sum(e).alias("n2"),
        F.sum(t * t * t - t).alias("ties"),
    )
    guided, other = F.when(F.col("is_guided") == 1, F.col("v")), F.when(F.col("is_guided") == 0, F.col("v"))
    moments = runs.agg(
        F.avg(guided).alias("m1"), F.avg(other).alias("m2"),
        F.coalesce(F.var_samp(guided), F.lit(0.0)).alias("s1"),
        F.coalesce(F.var_samp(other), F.lit(0.0)).alias("s2"),
    )
    one = F.lit(1).alias("one")  # both sides are one row
    totals = totals.select("*", one).join(F.broadcast(moments.select("*", one)), "one")
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    sigma = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    spread = F.sqrt(((n1 - 1) * F.col("s1") + (n2 - 1) * F.col("s2")) / (n - 2))
    return totals.select(
        n1.cast("bigint").alias("n_guided"), n2.cast("bigint").alias("n_exploration"),
        F.col("u").alias("mann_whitney_u"),
        ((F.col("u") - n1 * n2 / 2) / F.nullif(sigma, F.lit(0.0))).alias("z"),
        ((F.col("m1") - F.col("m2")) / F.nullif(spread, F.lit(0.0)) * (1 - 3 / (4 * n - 9)))
        .alias("hedges_g"),
    )
