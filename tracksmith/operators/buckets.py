"""Ordered buckets of a number, for ranks without a task that holds all rows.

Bounds are taken once and then are literals: a row's bucket depends on the row alone, however
often and over whatever partitions buckets are counted and sorted, so ranks are exact for any bounds.
"""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS, ROWS = 8, 10_000
MOST = 2**LEVELS


def points(value: Column) -> Column:
    """Percentiles from which :func:`bounds` chooses."""
    return F.percentile_approx(value, [i / MOST for i in range(1, MOST)])


def bounds(found: list[float] | None, rows: int) -> tuple[list[float], list[float]]:
    """Bounds that leave about ROWS of ``rows`` a bucket, and the values that hold several points."""
    found = [x for x in found or [] if x == x]
    step = max(1, -(-MOST * ROWS // max(1, rows)))
    often = sorted({a for a, b in pairwise(found) if a == b})
    return sorted({*found[step - 1 :: step], *often}), often


def part(value: Column, bounds: list[float], often: list[float]) -> Column:
    """2k at the k-th bound, if it is frequent, and 2k + 1 from it to the next, by binary search."""
    table = F.lit([float("nan"), *bounds, *[float("nan")] * (MOST - len(bounds))]).cast("array<double>")
    steps = F.lit([2**i for i in reversed(range(LEVELS))])
    below = F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.element_at(table, at + s + 1) <= value, at + s).otherwise(at))
    return below * 2 + F.when(is_often(value, often), 0).otherwise(1)


def is_often(value: Column, often: list[float]) -> Column:
    return F.array_contains(F.lit(often).cast("array<double>"), value) if often else F.lit(False)
