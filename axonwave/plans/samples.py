"""Samples (stream, ch, frame, code) from the event table, and the SQL that yields the same relation.

Rows of a stream and channel are numbered by their event id; codes are 10-bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from axonwave.operators.numbering import numbered

CHANNELS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    code = F.least(F.lit(1023), F.greatest(F.lit(0), F.bround("value", 0).cast("long")))
    e = e.select(F.lit(0).cast("long").alias("stream"), F.pmod("user_id", F.lit(CHANNELS)).cast("int").alias("ch"), "event_id", code.alias("code"))
    return numbered(e, ["stream", "ch"], "event_id", "frame").select("stream", "ch", "frame", "code")


SQL = """s AS (SELECT 0::BIGINT AS stream, (user_id % 8)::INT AS ch, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) - 1 AS frame,
    least(1023, greatest(0, round_even(value, 0)::BIGINT)) AS code FROM events)"""


def blocks(x: DataFrame, size: int = 64) -> DataFrame:
    """Whole blocks of frames: adds blk and p (place in the block); the incomplete last block of a channel is left out."""
    x = x.withColumns({"blk": (F.col("frame") / size).cast("long"), "p": F.pmod("frame", F.lit(size)).cast("int")})
    whole = F.count("*").over(Window.partitionBy("stream", "ch", "blk"))
    return x.withColumn("_n", whole).where(F.col("_n") == size).drop("_n", "frame")


def packets(x: DataFrame, frames: int) -> DataFrame:
    """Frames of whole packets, cut to the shortest channel of the stream: adds pkt."""
    length = x.groupBy("stream", "ch").agg((F.max("frame") + 1).alias("n")).groupBy("stream").agg(F.min("n").alias("n"))
    x = x.join(length, "stream").withColumn("pkt", F.floor(F.col("frame") / frames))
    return x.where(F.col("pkt") < F.floor(F.col("n") / frames)).drop("n")


def packets_sql(frames: int) -> str:
    return f"""k AS (SELECT s.*, frame // {frames} AS pkt FROM s WHERE frame // {frames} < (SELECT min(n) FROM (SELECT count(*) AS n FROM s GROUP BY ch)) // {frames})"""


BLOCKS_SQL = """b AS (SELECT stream, ch, frame // 64 AS blk, (frame % 64)::INT AS p, code FROM s QUALIFY count(*) OVER (PARTITION BY ch, frame // 64) = 64)"""
