"""Consecutive numbers for the rows of a large table in a given order, without one task that holds them all."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.plans.storage import spool


def numbered(df: DataFrame, *order, name: str = "number") -> DataFrame:
    """Adds `name`, from 1, in `order`, which must be total for the same numbers in every run.

    The table is sorted by ranges and stored with each row's range and place in it; the only window runs over one row a range.
    """
    place = F.monotonically_increasing_id()  # a range's number in the upper bits, the place in it in the lower 33
    placed = spool(df.orderBy(*order).withColumn("_place", place), "numbered").withColumn("_range", F.shiftright("_place", 33))
    counts = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_range", before.alias("_before"))
    number = F.col("_before") + F.col("_place").bitwiseAND((1 << 33) - 1) + 1
    return placed.join(F.broadcast(offsets), "_range").withColumn(name, number).drop("_range", "_place", "_before")
