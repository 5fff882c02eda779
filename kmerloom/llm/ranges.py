"""Rows in order of their id without one task that holds them all: range parts, and their running totals."""

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most parts; their bounds and totals are the only thing that reaches the driver.
MOST_PARTS = 4096


def bounds(ids: DataFrame, column: str, parts: int) -> list[int]:
    """Ids that cut the table into about equal parts, found from approximate quantiles of the id column alone."""
    parts = max(1, min(parts, MOST_PARTS))
    if parts == 1:
        return []
    cuts = ids.where(F.col(column).isNotNull()).approxQuantile(column, [i / parts for i in range(1, parts)], 1 / (8 * parts))
    return sorted({int(x) for x in cuts})


def part_of(column: str, cuts: list[int]) -> Column:
    """Number of the part of an id: how many cuts are at or below it; null ids are in the last part."""
    if not cuts:
        return F.lit(0)
    return F.when(F.col(column).isNull(), F.lit(len(cuts))).otherwise(_search(column, cuts, 0, len(cuts)))


def _search(column: str, cuts: list[int], lo: int, hi: int) -> Column:
    """A balanced tree of comparisons, so the expression is evaluated in a logarithmic number of steps."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(F.col(column) < cuts[mid], _search(column, cuts, lo, mid)).otherwise(_search(column, cuts, mid + 1, hi))


def part_number(value: int, cuts: list[int]) -> int:
    return bisect_right(cuts, value)
