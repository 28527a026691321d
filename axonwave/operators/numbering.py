"""Consecutive numbers for the rows of a key, without one sort over all of a key's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(x: DataFrame, keys: list[str], order: str, name: str = "n", span: int = 1 << 16) -> DataFrame:
    """x with name: the number (from 0) of each row among those of its keys, by order.

    order is an integer without repetition within the keys; neither is null. Rows are counted by ranges of span values;
    a row's number is what earlier ranges of its keys hold and its place in its own range. So the unit of work is a
    range, at most span rows, whichever key a third of the rows has; what is summed along a key are ranges.
    """
    ranged = x.withColumn("_range", F.floor(F.col(order) / span))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_size"))
    first = sizes.withColumn("_first", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    place = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(order)) - 1
    return ranged.withColumn("_place", place).join(first, [*keys, "_range"]).withColumn(name, (F.col("_first") + F.col("_place")).cast("long")).select(*x.columns, name)
