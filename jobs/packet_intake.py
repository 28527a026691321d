"""Incremental intake: samples that arrive as event files become lossless packets, by day.

    spark-submit jobs/packet_intake.py --source EVENTS --out FOLDER --checkpoint FOLDER --config jobs/packet_intake.json

Every user of the event table is a recorded stream of one channel, its events in order of event_id the samples.
A run takes the files that its checkpoint does not know yet (a file stream with availableNow), numbers their samples
after those taken before, encodes whole packets, and keeps the rest open for the next run.

Output, each in one folder a micro-batch, which a repeated batch replaces by the same rows:

    packets/batch=B/day=D   stream, pkt, seq, n_samples, first_event_id, last_event_id, packet
    rejected/batch=B        rows without event_id, user_id or value, and rows at or before their stream's mark ("late")
    marks/batch=B           stream, next_frame, last_event_id after the batch
    open/batch=B            samples of packets that are not complete

Events of one stream must come in files in the order of their ids (within a batch any order is right); an event that comes twice is
taken once. Groups are packets and ranges of event ids, so a stream with a third of all samples is many groups. The marks are a
row for each stream; they meet new samples by a join whose side Spark picks by size.
"""

from __future__ import annotations

import os
import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if not __package__:  # run as a file; workers on other machines get the packages by --py-files
    sys.path.insert(0, root := os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    os.environ["PYTHONPATH"] = os.pathsep.join([root, *filter(None, [os.environ.get("PYTHONPATH")])])

from axonwave.functions import coding  # noqa: E402
from axonwave.operators.numbering import numbered  # noqa: E402
from jobs.common import command_line, config_of, log, stored  # noqa: E402

MARKS = "stream long, next_frame long, last_event_id long, batch long"
OPEN = "stream long, frame long, event_id long, day string, code long, batch long"
PACKETS = "stream long, pkt long, seq int, n_samples int, first_event_id long, last_event_id long, packet binary, batch long, day string"
REJECTED = "event_id long, user_id long, value double, reason string, batch long"


@dataclass(frozen=True)
class Intake:
    frames: int = 32  #: samples of a packet
    top_code: int = 1023  #: codes are values rounded half to even and clipped to 0 .. top_code


def _packed(pkt: pd.Series, codes: pd.Series) -> pd.Series:
    return pd.Series([coding.rice_packet(np.asarray(c, np.int64)[:, None], int(k)) for k, c in zip(pkt, codes, strict=True)])


def taken(events: DataFrame, cfg: Intake) -> tuple[DataFrame, DataFrame]:
    """(samples: stream, event_id, day, code, one for each event id; rows that are none)."""
    whole = F.col("event_id").isNotNull() & F.col("user_id").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value")
    code = F.least(F.lit(cfg.top_code), F.greatest(F.lit(0), F.bround("value", 0).cast("long")))
    day = F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.lit("none"))
    good = events.where(whole).select(F.col("user_id").alias("stream"), "event_id", F.struct(day.alias("day"), code.alias("code")).alias("of"))
    one = good.groupBy("stream", "event_id").agg(F.min("of").alias("of"))  # if an event came twice with two values, the same one is taken in every run
    bad = events.where(~whole).select("event_id", "user_id", "value", F.lit("incomplete").alias("reason"))
    return one.select("stream", "event_id", "of.day", "of.code"), bad


def packets_of(samples: DataFrame, cfg: Intake) -> DataFrame:
    """stream, frame, event_id, day, code of whole packets -> one row for each packet, dated by its last sample."""
    each = samples.groupBy("stream", F.floor(F.col("frame") / cfg.frames).alias("pkt")).agg(F.array_sort(F.collect_list(F.struct("frame", "event_id", "day", "code"))).alias("s"))
    first, last = F.element_at("s", 1), F.element_at("s", -1)
    return each.select(
        "stream", "pkt", F.pmod("pkt", F.lit(64)).cast("int").alias("seq"), F.size("s").alias("n_samples"), first["event_id"].alias("first_event_id"), last["event_id"].alias("last_event_id"),
        F.pandas_udf(_packed, "binary")("pkt", F.col("s.code")).alias("packet"), last["day"].alias("day"))


def take_batch(events: DataFrame, batch: int, out: str, cfg: Intake) -> None:
    """One micro-batch. It depends on the rows and on what earlier batches left, so doing it again changes nothing."""
    spark, events = events.sparkSession, events.persist()  # several writes read it; what an executor loses is read again
    try:
        read = events.count()
        _write_batch(spark, events, batch, out, cfg)
    finally:
        events.unpersist()
    n = spark.read.schema(PACKETS).parquet(f"{out}/packets").where(F.col("batch") == batch).count()
    log.info("batch %s: read %s new rows, wrote %s packets to %s", batch, read, n, out)


def _write_batch(spark: SparkSession, events: DataFrame, batch: int, out: str, cfg: Intake) -> None:
    marks = stored(spark, f"{out}/marks", MARKS).where(F.col("batch") < batch)
    last = marks.agg(F.max("batch")).first()[0]  # from the names of the folders
    marks = marks.where(F.col("batch") == F.lit(last)).drop("batch")
    held = stored(spark, f"{out}/open", OPEN).where(F.col("batch") == F.lit(last)).drop("batch")

    samples, bad = taken(events, cfg)
    known = samples.join(marks, "stream", "left")
    late = F.coalesce(F.col("event_id") <= F.col("last_event_id"), F.lit(False))
    new = known.where(~late).withColumn("next_frame", F.coalesce("next_frame", F.lit(0)))
    new = numbered(new, ["stream"], "event_id", "place").withColumn("frame", F.col("next_frame") + F.col("place"))
    new = new.select("stream", "frame", "event_id", "day", "code").persist()

    per = new.groupBy("stream").agg(F.max(F.col("frame") + 1).alias("n"), F.max("event_id").alias("to"))
    marks_after = marks.join(per, "stream", "full").select("stream", F.coalesce("n", "next_frame").alias("next_frame"), F.coalesce("to", "last_event_id").alias("last_event_id"))
    put = lambda df, name: df.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch}")
    put(marks_after, "marks")
    after = spark.read.schema(MARKS.replace(", batch long", "")).parquet(f"{out}/marks/batch={batch}")

    rows = held.unionByName(new)
    rows = rows.join(after.select("stream", (F.floor(F.col("next_frame") / cfg.frames) * cfg.frames).alias("whole")), "stream")
    put(rows.where("frame >= whole").drop("whole"), "open")
    whole = packets_of(rows.where("frame < whole"), cfg)
    whole.write.mode("overwrite").partitionBy("day").parquet(f"{out}/packets/batch={batch}")
    new.unpersist()
    reasons = known.where(late).select("event_id", F.col("stream").alias("user_id"), F.col("code").cast("double").alias("value"), F.lit("late").alias("reason"))
    put(bad.unionByName(reasons), "rejected")


def run(spark: SparkSession, source: str, out: str, checkpoint: str, cfg: Intake = Intake()) -> DataFrame:
    """Takes what is new at source and returns all packets so far: stream, pkt, seq, n_samples, first_event_id, last_event_id, packet, day."""
    schema = spark.read.parquet(source).select("event_id", "ts", "user_id", "value").schema
    source = source.rstrip("/")
    events = spark.readStream.schema(schema).parquet(f"{source[:-1]}[{source[-1]}]")  # a pattern for source alone: without one, a table of a single file is refused
    flow = events.writeStream.foreachBatch(lambda df, batch: take_batch(df, batch, out, cfg)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        flow.awaitTermination()
    finally:
        flow.stop()
    log.info("%s is taken as far as it goes", source)
    return packets(spark, out)


def packets(spark: SparkSession, out: str) -> DataFrame:
    return stored(spark, f"{out}/packets", PACKETS).drop("batch")


def main() -> None:
    args = command_line(__doc__.splitlines()[0], ("source", "Parquet table of events that grows by files"), ("out", "folder of the output"), ("checkpoint", "folder of the stream's checkpoint"))
    spark = SparkSession.builder.appName("packet_intake").getOrCreate()
    try:
        n = run(spark, args.source, args.out, args.checkpoint, config_of(spark, args.config, Intake)).count()
        log.info("%s packets in %s", n, args.out)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
