"""Frames and packets of a slot stream with malformed frames, aborts, overflows and enable periods, as windows over all tokens.

Tokens are rows (stream, clock, kind, start, code); clocks are integers, unique and ascending in a stream.

- `enable` begins a segment, `disable` ends it; tokens outside segments do nothing, nor does a second enable or disable.
- A `slot` with start begins a frame; slots before the first start of a segment do nothing. A frame takes its first n_slots slots that come
  before start + limit; more are ignored. It closes when it has them all, else short: at the next start or at its limit.
- Every frames_per_packet frames of a segment, from 0, are a packet; its number counts on through losses.
- A short frame is repaired (a missing slot repeats the last code in that place, 512 before the first) or aborts its packet. An `abort` token aborts the
  open packet. An aborted packet is discarded whole; the next one starts with its own first frame.
- `disable` discards the open packet (status eof). `overflow` marks every packet that closes later in the segment.

`axonwave.streaming.frames` gives the same rows in a stream. Windows run along a stream or segment; parallelism is streams.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PACKETS = "stream long, seg long, pkt long, seq int, status string, frames int, short int, overflow boolean, total long"


@dataclass(frozen=True)
class FramePolicy:
    n_slots: int = 256
    frames_per_packet: int = 256
    limit: int = 512  #: clocks after its start at which a frame that is not full closes short
    on_short: str = "repair"  #: or "abort"
    idle: int = 512  #: the code of a place that no frame has filled

    def __post_init__(self):
        if self.on_short not in ("repair", "abort"):
            raise ValueError(self.on_short)


def segmented(tokens: DataFrame) -> DataFrame:
    """Tokens inside segments, with seg (from 1) and seg_end (the clock of its disable, or null)."""
    w = Window.partitionBy("stream").orderBy("clock")
    on = F.coalesce(F.last(F.when(F.col("kind").isin("enable", "disable"), F.col("kind")), True).over(w) == "enable", F.lit(False))
    t = tokens.withColumn("_on", on).withColumn("_begins", F.col("_on") & ~F.coalesce(F.lag("_on").over(w), F.lit(False)))
    t = t.withColumn("seg", F.sum(F.col("_begins").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("seg > 0")
    t = t.withColumn("seg_end", F.min(F.when(~F.col("_on"), F.col("clock"))).over(Window.partitionBy("stream", "seg")))
    return t.where("_on").drop("_on", "_begins")


def framed(tokens: DataFrame, cfg: FramePolicy, upto: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(tokens of segments with the frame they fall in, slots with their place; one row for each closed frame). upto: the clock that has been reached."""
    run = Window.partitionBy("stream", "seg").orderBy("clock").rowsBetween(Window.unboundedPreceding, 0)
    t = segmented(tokens).withColumn("frame", F.sum(((F.col("kind") == "slot") & F.col("start")).cast("long")).over(run) - 1).where("frame >= 0")
    own = Window.partitionBy("stream", "seg", "frame")
    s = t.where("kind = 'slot'").withColumn("place", F.row_number().over(own.orderBy("clock")) - 1).withColumn("from", F.min("clock").over(own))
    s = s.where((F.col("place") < cfg.n_slots) & (F.col("clock") < F.col("from") + cfg.limit))
    f = s.groupBy("stream", "seg", "frame").agg(F.first("from").alias("from"), F.count("*").alias("n"), F.max("clock").alias("last"), F.sum("code").alias("total"), F.first("seg_end").alias("seg_end"))
    f = f.withColumn("next", F.lead("from").over(Window.partitionBy("stream", "seg").orderBy("frame")))
    full, limit = F.col("n") == cfg.n_slots, F.col("from") + cfg.limit
    cut = ~full & F.coalesce(F.col("seg_end") < F.least(F.coalesce("next", limit), limit), F.lit(False))
    closed = full | (~cut & (F.col("next").isNotNull() | F.col("seg_end").isNotNull() | (limit <= F.lit(upto) if upto is not None else F.lit(False))))
    f = f.withColumns({"closed": closed, "end": F.when(full, F.col("last")).otherwise(F.least("next", limit))})
    return t.join(s.select("stream", "clock", "place"), ["stream", "clock"], "left"), f


def _totals(slots: DataFrame, frames: DataFrame, cfg: FramePolicy) -> DataFrame:
    """Sum of the codes of each closed frame, missing places filled from the frames before."""
    grid = frames.where("closed").select("stream", "seg", "frame", F.explode(F.sequence(F.lit(0), F.lit(cfg.n_slots - 1))).alias("place"))
    known = slots.where("place IS NOT NULL").select("stream", "seg", "frame", "place", "code")
    w = Window.partitionBy("stream", "seg", "place").orderBy("frame")
    filled = grid.join(known, ["stream", "seg", "frame", "place"], "left").withColumn("code", F.coalesce(F.last("code", True).over(w), F.lit(cfg.idle)))
    return filled.groupBy("stream", "seg", "frame").agg(F.sum("code").alias("total"))


def frame_packets(tokens: DataFrame, cfg: FramePolicy = FramePolicy(), upto: int | None = None) -> DataFrame:
    """Tokens -> PACKETS: packets that are complete, aborted, or open at their segment's end (eof); total of complete ones."""
    t, f = framed(tokens, cfg, upto)
    if cfg.on_short == "repair":
        f = f.drop("total").join(_totals(t, f, cfg), ["stream", "seg", "frame"], "left")
    pkt = F.floor(F.col("frame") / cfg.frames_per_packet)
    p = f.groupBy("stream", "seg", pkt.alias("pkt")).agg(
        F.count_if("closed").cast("int").alias("frames"), F.count_if(F.col("closed") & (F.col("n") < cfg.n_slots)).cast("int").alias("short"),
        F.max("end").alias("end"), F.first("seg_end").alias("seg_end"), F.sum(F.when(F.col("closed"), F.col("total"))).alias("total"))
    whole = F.col("frames") == cfg.frames_per_packet
    p = p.where(whole | F.col("seg_end").isNotNull()).withColumn("end", F.when(whole, F.col("end")).otherwise(F.col("seg_end")))
    at = t.where("kind = 'abort'").groupBy("stream", "seg", pkt.alias("pkt")).agg(F.min("clock").alias("abort"))
    over = segmented(tokens).where("kind = 'overflow'").groupBy("stream", "seg").agg(F.min("clock").alias("over"))
    p = p.join(at, ["stream", "seg", "pkt"], "left").join(over, ["stream", "seg"], "left")
    lost = F.coalesce(F.col("abort") < F.col("end"), F.lit(False)) | ((F.col("short") > 0) & F.lit(cfg.on_short == "abort"))
    status = F.when(lost, "aborted").when(whole, "complete").otherwise("eof")
    p = p.withColumn("status", status)
    return p.select(
        "stream", "seg", "pkt", F.pmod("pkt", F.lit(64)).cast("int").alias("seq"), "status", "frames", "short", F.coalesce(F.col("over") < F.col("end"), F.lit(False)).alias("overflow"),
        F.when(F.col("status") == "complete", F.col("total")).cast("long").alias("total"))
