"""Predicates, flags and arithmetic used by many queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailmetrics.sources.schemas import COMPLETE, FAIL, GUIDED, TOOL_CALL_PREFIX


def is_tool_call() -> Column:
    return F.col("tool_name").isNotNull() & F.col("activity").startswith(TOOL_CALL_PREFIX)


def is_terminal() -> Column:
    return F.col("activity").isin(COMPLETE, FAIL)


def is_mode_event() -> Column:
    return F.col("activity").isin(GUIDED, "optimize:exploration")


def success_value(status: str = "status") -> Column:
    """1.0 for success, 0.0 for anything else; a missing status counts as 0."""
    return F.when(F.col(status) == "success", 1.0).otherwise(0.0)


def mode_label(flag: Column) -> Column:
    return F.when(flag, "guided").otherwise("exploration")


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, NULL where bottom is 0 or NULL."""
    return top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))


def percent_improvement(baseline: Column, improved: Column) -> Column:
    """Change in percent of the baseline to 2 decimals; 0 for a zero baseline."""
    base = F.coalesce(baseline.cast("double"), F.lit(0.0))
    other = F.coalesce(improved.cast("double"), F.lit(0.0))
    return F.when(base == 0, 0.0).otherwise(
        F.round((base - other) / F.nullif(base, F.lit(0.0)) * 100, 2)
    )


def change_percent(before: Column, after: Column) -> Column:
    """(before - after) / before * 100, 0 where before is 0."""
    return F.when(before == 0, 0.0).otherwise(
        (before - after) / F.nullif(before, F.lit(0.0)) * 100
    )


def delta_label(before: Column, after: Column) -> Column:
    pct = change_percent(before, after)
    return F.when(before == 0, "-").otherwise(
        F.concat(
            F.when(pct > 0, "↓").otherwise("↑"),
            F.round(F.abs(pct), 0).cast("bigint"),
            F.lit("%"),
        )
    )


def verdict(delta: Column, lower_is_better: bool) -> Column:
    """``good`` / ``bad`` / ``neutral`` for (before - after)."""
    good = delta > 0 if lower_is_better else delta < 0
    return F.when(delta == 0, "neutral").when(good, "good").otherwise("bad")


def status_of_run(failed: Column, second: Column, second_label: str) -> Column:
    """failure first, then the second state (timeout or in_progress), else success."""
    return F.when(failed, "failure").when(second, second_label).otherwise("success")


def conformance_band(percent: Column) -> Column:
    return F.when(percent >= 80, "high").when(percent >= 50, "medium").otherwise("low")


def latency_band(ms: Column) -> Column:
    return F.when(ms < 500, "fast").when(ms < 2000, "medium").otherwise("slow")


def stroke_width(weight: Column, heaviest: Column) -> Column:
    return F.greatest(F.lit(1.0), F.round(weight / heaviest * 5))


def dot_radius(size: Column) -> Column:
    return F.greatest(F.lit(4.0), F.least(F.lit(18.0), F.sqrt(size) * 0.4))


def money(amount: Column) -> Column:
    """Amount rounded to cents; the small addend makes half cents round up whatever
    the last bit of the product was."""
    return F.round(amount.cast("double") + 1e-9, 2)
