"""Islands of closed intervals by a running maximum: no interval is compared with another."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.plans.storage import spool

#: Intervals of one group from which it is spread over tasks.
GROUP = 1_000_000


def normalized(rows: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Swaps the ends of intervals that run backwards."""
    return rows.withColumns({start: F.least(start, end), end: F.greatest(start, end)})


def largest_group(rows: DataFrame, by: list[str]) -> int:
    return rows.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def islands(rows: DataFrame, by: list[str], start: str = "start", end: str = "end", spread: bool = False) -> DataFrame:
    """Adds `island`, numbered from 1 within `by`: intervals that share a point, directly or over others, are in one; (1,2) and (3,4) share none.

    A group of `by` is sorted in one task. With `spread` it isn't, at the price of a stored copy and two small joins: for groups above GROUP (see largest_group).
    """
    if spread:
        return _spread(rows, by, start, end)
    order = Window.partitionBy(*by).orderBy(start, end)
    reached = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reached.isNull() | (F.col(start) > reached), 1).otherwise(0)
    return rows.withColumn("_new", new).withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def _spread(rows: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Islands range by range: what the ranges before reach, and how many islands they have, is one row a group and range."""
    rows = rows.repartitionByRange(*by, start, end).sortWithinPartitions(*by, start, end)
    rows = spool(rows.withColumn("_range", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id()), "intervals")
    inside, over = Window.partitionBy(*by, "_range").orderBy("_place"), Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)

    def carried(rows: DataFrame, value, total, name: str) -> DataFrame:
        """rows with `name`: `total` of the group's ranges before of each range's `value`."""
        parts = rows.groupBy(*by, "_range").agg(value.alias("_v")).select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_range").alias("_at"), *by, "_range", "_v")
        parts = parts.withColumn(name, total("_v").over(over)).select(*[f"_{c}" for c in by], "_at", name)
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], F.col("_range") == F.col("_at"))
        return rows.join(parts, same).drop("_at", *[f"_{c}" for c in by])

    rows = carried(rows, F.max(end), F.max, "_before")
    reached = F.greatest("_before", F.max(end).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    rows = spool(rows.withColumn("_new", F.when(reached.isNull() | (F.col(start) > reached), 1).otherwise(0)), "intervals")
    rows = carried(rows, F.sum("_new"), F.sum, "_count")
    island = F.coalesce("_count", F.lit(0)) + F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("island", island.cast("int")).drop("_range", "_place", "_before", "_new", "_count")


def merged(rows: DataFrame, by: list[str], start: str = "start", end: str = "end", spread: bool = False) -> DataFrame:
    """(by, island, start, end, n_intervals, length): one row an island."""
    out = islands(rows, by, start, end, spread).groupBy(*by, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_intervals"))
    return out.withColumn("length", F.col(end) - F.col(start) + 1)
