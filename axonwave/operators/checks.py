"""Checks of captured streams before any decoding, and the finding that a report leads with."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values: kinds of findings, the most specific first
RANK = (
    "row_stuck row_bit shared_stuck slot state_flip rom coder_wb coder_xl state_row_bit flush byte_corrupt byte_drop byte_insert pin_stuck readback_bits seq_bit seq_upset header coder "
    "slot_partial datapath_unexplained readback_dead coder_stall no_frames no_output stuck_output no_last seq_gap trailing abort"
).split()

FINDING = ("stream", "kind", "packet", "data")


def _finding(df: DataFrame, kind, packet=None, data=None) -> DataFrame:
    none = F.lit(None).cast("long")
    return df.select("stream", (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), (none if packet is None else packet).cast("long").alias("packet"), (none if data is None else data).cast("long").alias("data"))


def readback(registers: DataFrame) -> DataFrame:
    """Findings of registers(stream, addr, got, want): dead if all are wrong and read the same, else the bits that differ."""
    x = F.col("got").bitwiseXOR(F.col("want"))
    r = registers.groupBy("stream").agg(F.count("*").alias("n"), F.count_if(x != 0).alias("bad"), F.count_distinct("got").alias("values"), F.bit_or(x).alias("bits"))
    dead = (F.col("bad") == F.col("n")) & (F.col("values") == 1) & (F.col("n") > 1)
    return _finding(r.where("bad > 0"), F.when(dead, "readback_dead").otherwise("readback_bits"), data=F.when(~dead, F.col("bits")))


def stream_findings(tokens: DataFrame, expected: DataFrame, streams: DataFrame, least: int = 64) -> DataFrame:
    """stream, kind, packet, data of captures: tokens(stream, pos, kind 'B', 'A' or 'O', v, last), expected(stream, v) bytes, streams(stream) that were to be captured.

    no_output: neither bytes nor aborts. stuck_output: more than 8 bytes, all the same (data). no_last: bytes, but no packet ends. pin_stuck: a bit (data) that never
    changes in at least so many bytes, though it does in those expected. seq_gap: the first packet whose header does not follow the header before. trailing: bytes after the
    last packet (data: how many). abort: the first packet that was aborted (data: how many). All are sums by stream but the sequence, which is a window over the headers.
    """
    b = F.col("kind") == "B"
    of = tokens.groupBy("stream").agg(
        F.count_if(b).alias("n"), F.count_if(F.col("kind") == "A").alias("aborts"), F.count_distinct(F.when(b, F.col("v"))).alias("values"), F.min(F.when(b, F.col("v"))).alias("v"),
        F.bit_and(F.when(b, F.col("v"))).alias("ones"), F.bit_or(F.when(b, F.col("v"))).alias("any"), F.count_if(b & F.col("last")).alias("ends"), F.max(F.when(b & F.col("last"), F.col("pos"))).alias("end"))
    want = expected.groupBy("stream").agg(F.bit_or("v").bitwiseAND(F.bitwise_not(F.bit_and("v"))).alias("moves"))
    silent = streams.join(of.where("n + aborts > 0"), "stream", "left_anti")
    still = F.col("ones").bitwiseOR(F.bitwise_not(F.col("any")))
    pins = of.where((F.col("n") >= least) & (F.col("values") > 1)).join(want, "stream").select("stream", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit"), still.bitwiseAND(F.col("moves")).alias("stuck"))
    run = Window.partitionBy("stream").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    t = tokens.where("kind != 'O'").withColumn("pkt", F.coalesce(F.sum((F.col("last") | (F.col("kind") == "A")).cast("long")).over(run), F.lit(0)))
    heads = t.groupBy("stream", "pkt").agg(F.min_by(F.when(b, F.col("v")), "pos").alias("head"), F.count_if(b).alias("n"), F.count_if(F.col("kind") == "A").alias("aborted"))
    w = Window.partitionBy("stream").orderBy("pkt")
    seq = F.col("head").bitwiseAND(F.lit(63))
    gaps = heads.where("head IS NOT NULL").withColumn("jump", F.pmod(seq - F.lag(seq).over(w), F.lit(64)) != 1).where("jump").groupBy("stream").agg(F.min("pkt").alias("pkt"), F.count("*").alias("gaps"))
    after = tokens.where(b).join(of.where("ends > 0").select("stream", "end"), "stream").where(F.col("pos") > F.col("end")).groupBy("stream").agg(F.count("*").alias("left"))
    aborted = heads.where("aborted > 0").groupBy("stream").agg(F.min("pkt").alias("pkt"), F.count("*").alias("times"))
    all_ = [
        _finding(silent, "no_output"), _finding(of.where("values = 1 AND n > 8"), "stuck_output", data=F.col("v")), _finding(of.where("n > 0 AND ends = 0"), "no_last"),
        _finding(pins.where("shiftright(stuck, bit) % 2 = 1"), "pin_stuck", data=F.col("bit")), _finding(gaps, "seq_gap", F.col("pkt"), F.col("gaps")),
        _finding(after, "trailing", data=F.col("left")), _finding(aborted, "abort", F.col("pkt"), F.col("times"))]
    out = all_[0]
    for f in all_[1:]:
        out = out.unionByName(f)
    return out


def verdicts(findings: DataFrame, kinds: list[str] = RANK) -> DataFrame:
    """The finding of the most specific kind of each stream: of the earliest packet, and the least data, on ties. Kinds without a rank lead nothing."""
    rank = F.create_map(*[F.lit(x) for k, name in enumerate(kinds) for x in (name, k)])
    r = findings.withColumn("rank", F.element_at(rank, F.col("kind"))).where("rank IS NOT NULL")
    first = F.struct("rank", F.coalesce("packet", F.lit(-1)).alias("p"), F.coalesce("data", F.lit(-1)).alias("d"))
    return r.groupBy("stream").agg(F.min_by(F.struct("kind", "packet", "data"), first).alias("f"), F.count("*").alias("of")).select("stream", "f.*", "of")
