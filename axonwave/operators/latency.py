"""Latencies between two kinds of events of a stream, by clock."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def next_at(left: DataFrame, right: DataFrame, keys: list[str], clock: str, name: str) -> DataFrame:
    """left with name: the clock of the first row of right, of the same keys, at or after its own (null if there is none).

    Both are sorted together and the clock is carried back from the right rows; no row is paired with a range of others.
    """
    mine = left.withColumn("_right", F.lit(None).cast(left.schema[clock].dataType)).withColumn("_mine", F.lit(True))
    theirs = right.select(*keys, clock).withColumn("_right", F.col(clock)).withColumn("_mine", F.lit(False))
    w = Window.partitionBy(*keys).orderBy(F.col(clock).desc(), "_mine").rowsBetween(Window.unboundedPreceding, 0)
    both = mine.unionByName(theirs, allowMissingColumns=True).withColumn(name, F.last("_right", True).over(w))
    return both.where("_mine").drop("_right", "_mine")


def delivery_latency(pushed: DataFrame, coded: DataFrame, ended: DataFrame, keys: list[str], horizon: int) -> DataFrame:
    """keys, n, pushed, coded, ended, processing, delivery of each sample whose symbols are coded.

    pushed, coded, ended: keys and clock of samples taken in, symbols coded, packets ended. The n-th symbol is the n-th sample's; a sample is processed when the last symbol that
    depends on it, horizon samples later, is coded, and delivered when the packet that has it ends.
    """
    order = Window.partitionBy(*keys).orderBy("clock")
    a = pushed.select(*keys, F.col("clock").alias("pushed"), F.row_number().over(order).alias("n"))
    b = coded.select(*keys, "clock", (F.row_number().over(order) - horizon).alias("n"))
    j = next_at(a.join(b, [*keys, "n"]), ended.select(*keys, "clock"), keys, "clock", "ended")
    return j.select(*keys, "n", "pushed", F.col("clock").alias("coded"), "ended", (F.col("clock") - F.col("pushed")).alias("processing"), (F.col("ended") - F.col("pushed")).alias("delivery"))
