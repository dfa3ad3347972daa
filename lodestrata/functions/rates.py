"""Ratios, percentiles and bounds with the evaluation's conventions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """``a / b``; 0 where ``b`` is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def rate(flag: Column) -> Column:
    """Share of true rows, rounded to 4 places; 0 without rows."""
    return F.coalesce(F.round(F.avg(flag.cast("double")), 4), F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def percentile_rank(n: Column, q: float, rule: str) -> Column:
    """0-based place in ascending order of quantile ``q`` among ``n`` values.

    ``nearest``: half-even rounding of (n - 1) q. ``floor``: its integer part. ``capped``: the integer part of n q, at most n - 1.
    """
    if rule == "nearest":
        return F.bround((n - 1) * F.lit(q), 0).cast("int")
    return F.floor((n - 1) * F.lit(q)).cast("int") if rule == "floor" else F.least(n - 1, F.floor(n * F.lit(q))).cast("int")


def wilson_lower(passed: Column, n: Column, z: float = 1.96) -> Column:
    """Lower end of Wilson's interval for a pass rate; 0 without trials."""
    p = ratio(passed, n)
    centre = p + z * z / (2 * n)
    spread = z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    return F.when(n > 0, (centre - spread) / (1 + z * z / n)).otherwise(0.0)


def failed_names(checks: dict[str, Column]) -> Column:
    """Sorted names of the checks that do not hold."""
    return F.array_sort(F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()])))
