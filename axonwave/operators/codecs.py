"""Packet codecs as DataFrame -> DataFrame: samples in, packets out, and back.

Encoding is parallel as far as the formats allow: mode 0 by packet; mode 1 by packet and channel
(each channel has its own coder state and tables are fixed, so only the bytes are merged, by coding position); modes 2
and 3 by packet after the front end, which runs along each channel. Decoding is by packet, since a packet has one read position.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axonwave.functions import coding
from axonwave.functions.coding import FrontEnd, RiceConfig
from axonwave.operators import wavelet
from axonwave.operators.wavelet import LossyConfig
from axonwave.plans.samples import blocks, packets

PACKETS = "stream long, pkt long, mode int, seq int, bytes binary"


def _matrix(pdf: pd.DataFrame, value: str = "code"):
    return pdf.pivot(index="frame", columns="ch", values=value).sort_index().sort_index(axis=1).to_numpy()


def encode_lossless(x: DataFrame, cfg: RiceConfig = RiceConfig()) -> DataFrame:
    def one(pdf):
        s, k = int(pdf.stream.iloc[0]), int(pdf.pkt.iloc[0])
        return pd.DataFrame([(s, k, 0, k & 63, coding.rice_packet(_matrix(pdf), k, cfg))], columns=["stream", "pkt", "mode", "seq", "bytes"])

    return packets(x, cfg.frames).groupBy("stream", "pkt").applyInPandas(one, PACKETS)


def decode_lossless(p: DataFrame, n_ch: int, cfg: RiceConfig = RiceConfig()) -> DataFrame:
    def many(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                y = coding.rice_unpacked(bytes(r.bytes), cfg.frames, n_ch, r.pkt, cfg)
                t, c = y.shape
                yield pd.DataFrame({"stream": r.stream, "ch": list(range(c)) * t, "frame": [r.pkt * t + i for i in range(t) for _ in range(c)], "code": y.reshape(-1)})

    return p.mapInPandas(many, "stream long, ch int, frame long, code long")


def trained_tables(sym: DataFrame, cfg: LossyConfig = LossyConfig()) -> list[list[int]]:
    """One cumulative table for each context, from symbol counts (contexts x symbols numbers)."""
    counts = [[0] * cfg.n_sym for _ in range(cfg.levels + 1)]
    for r in sym.groupBy("ctx", "sym").count().collect():
        counts[r.ctx][r.sym] = r["count"]
    total = 1 << cfg.prob_bits
    return coding.checked_tables([coding.cumulative(coding.normalised(c, total)) for c in counts], cfg.levels + 1, cfg.n_sym, total)


def whole_packets(sym: DataFrame, n_ch: int, cfg: LossyConfig = LossyConfig()) -> DataFrame:
    full = sym.groupBy("stream", "pkt").count().where(F.col("count") == n_ch * cfg.frames).select("stream", "pkt")
    return sym.join(full, ["stream", "pkt"], "left_semi")


def encode_lossy(sym: DataFrame, tables, n_ch: int, cfg: LossyConfig = LossyConfig()) -> DataFrame:
    """Symbols of whole packets -> packets."""
    total, flush = 1 << cfg.prob_bits, cfg.n_flush or n_ch

    def channel(pdf):
        pdf = pdf.sort_values("pos")
        esc = cfg.n_sym - 1
        raw = [(2 * v if v >= 0 else -2 * v - 1).to_bytes(cfg.esc_bytes, "little") if s == esc else None for v, s in zip(pdf.v.tolist(), pdf.sym.tolist(), strict=True)]
        out, x = coding.rans_channel(pdf.pos.tolist(), pdf.ctx.tolist(), pdf.sym.tolist(), raw, tables, total, cfg.lsh)
        ch = int(pdf.ch.iloc[0])
        rows = [*out, *([(1 << 40 | ch, x.to_bytes(3, "little"))] if ch < flush else [])]
        return pd.DataFrame({"stream": int(pdf.stream.iloc[0]), "pkt": int(pdf.pkt.iloc[0]), "pos": [r[0] for r in rows], "bytes": [r[1] for r in rows]})

    def assemble(pdf):
        s, k = int(pdf.stream.iloc[0]), int(pdf.pkt.iloc[0])
        idle = (total << cfg.lsh).to_bytes(3, "little")
        body = b"".join(pdf.sort_values("pos").bytes) + idle * (flush - min(flush, n_ch))
        return pd.DataFrame([(s, k, 1, k & 63, bytes([coding.header(1, k)]) + body)], columns=["stream", "pkt", "mode", "seq", "bytes"])

    parts = sym.select("stream", "pkt", "ch", "ctx", "v", "sym", "pos").groupBy("stream", "pkt", "ch").applyInPandas(channel, "stream long, pkt long, pos long, bytes binary")
    return parts.groupBy("stream", "pkt").applyInPandas(assemble, PACKETS)


def coding_order(n_ch: int, cfg: LossyConfig = LossyConfig()) -> list[tuple[int, int, int, int]]:
    """(block, channel, context, index) of each symbol of a packet, in coding order."""
    bands = [(0, i) for i in range(cfg.block >> cfg.levels)] + [(k, i) for k in range(1, cfg.levels + 1) for i in range(cfg.block >> k)]
    when = lambda k, i: (min(cfg.block - 1, ((i + 2) << (k or cfg.levels)) - 2), k or cfg.levels + 1)
    one = sorted((when(k, i)[0], c, when(k, i)[1], k, i) for k, i in bands for c in range(n_ch))
    return [(b, c, k, i) for b in range(cfg.blocks_per_packet) for _, c, _, k, i in one]


def decode_lossy(p: DataFrame, tables, n_ch: int, cfg: LossyConfig = LossyConfig()) -> DataFrame:
    """Packets -> stream, ch, blk, p, y: entropy decoding by packet, then the inverse transform as a DataFrame."""
    order, flush, esc = coding_order(n_ch, cfg), cfg.n_flush or n_ch, cfg.n_sym - 1

    def many(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                data = bytes(r.bytes)
                if data[0] != coding.header(1, r.pkt):
                    raise ValueError("wrong mode or sequence number")
                got = coding.rans_unpacked(data[1:], [(c, k) for _, c, k, _ in order], tables, flush, esc, cfg.esc_bytes, cfg.lsh)
                v = [s - cfg.s_max if raw is None else (-((m + 1) >> 1) if (m := int.from_bytes(raw, "little")) & 1 else m >> 1) for s, raw in got]
                b, c, k, i = zip(*order, strict=True)
                p = [(j << cfg.levels) if q == 0 else (j << q) + (1 << (q - 1)) for q, j in zip(k, i, strict=True)]
                yield pd.DataFrame({"stream": r.stream, "ch": c, "blk": [r.pkt * cfg.blocks_per_packet + x for x in b], "p": p, "ctx": k, "v": v})

    q = p.mapInPandas(many, "stream long, ch int, blk long, p int, ctx int, v long")
    run = Window.partitionBy("stream", "ch", "blk", "ctx").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    q = q.withColumn("q", F.when(F.col("ctx") == 0, F.sum("v").over(run)).otherwise(F.col("v")))
    q = q.withColumn("dq", wavelet.by_ctx(lambda k: wavelet.dequantise(F.col("q"), cfg.shift(k)), cfg.levels))
    y = wavelet.inverse(q, cfg.levels, "dq")
    return y.select("stream", "ch", "blk", "p", F.greatest(F.lit(0), F.least(F.lit((1 << cfg.adc_bits) - 1), F.col("x"))).alias("y"))


SYMBOL = "stream long, pkt long, ch int, pos long, sym long"


def _run(reset_every: int | None):
    return F.floor(F.col("pkt") / reset_every) if reset_every else F.lit(0).cast("long")


def encode_adaptive(sym: DataFrame, n_ch: int, reset_every: int | None = None, n_sym: int = 64, cap: int = 4096 - 64, lsh: int = 11) -> DataFrame:
    """Symbols (stream, pkt, ch, pos, sym) -> stream, pkt, bytes. A packet's table is one more than the counts of the packet before.

    Only the counts of the first cap symbols go from packet to packet, by a join, so all packets are coded at once. The first packet, every
    reset_every-th one, and one whose predecessor is missing begin with equal frequencies.
    """
    counts = sym.where(F.col("pos") < cap).groupBy("stream", "pkt", "sym").agg(F.count("*").alias("n")).groupBy("stream", "pkt").agg(F.map_from_entries(F.collect_list(F.struct("sym", "n"))).alias("t"))
    prev = counts.select("stream", (F.col("pkt") + 1).alias("pkt"), "t")
    if reset_every:
        prev = prev.where(F.pmod("pkt", F.lit(reset_every)) != 0)

    def one(t, pos, ch, s):
        return pd.Series([coding.adaptive_packed(*zip(*sorted(zip(*r[1:], strict=True)), strict=True), [dict(r[0] or {}).get(k, 0) for k in range(n_sym)], n_ch, lsh) for r in zip(t, pos, ch, s, strict=True)])

    one.__annotations__ = {"t": pd.Series, "pos": pd.Series, "ch": pd.Series, "s": pd.Series, "return": pd.Series}
    each = sym.groupBy("stream", "pkt").agg(F.collect_list(F.struct("pos", "ch", "sym")).alias("s")).join(prev, ["stream", "pkt"], "left")
    return each.select("stream", "pkt", F.pandas_udf(one, "binary")("t", F.col("s.pos"), F.col("s.ch"), F.col("s.sym")).alias("bytes"))


def decode_adaptive(p: DataFrame, channels: list[int], n_ch: int, reset_every: int | None = None, n_sym: int = 64, cap: int = 4096 - 64, lsh: int = 11) -> DataFrame:
    """stream, pkt, bytes -> SYMBOL, from the bytes alone: the table of a packet comes from the decoded one before it.

    channels: the channel of each position of a packet. Packets are dealt by stream and run (reset_every packets that begin with equal
    frequencies), and each task reads its runs in order, a batch of packets at a time. A packet after a missing or damaged one cannot be read
    before its run ends and has no rows.
    """

    def many(batches):
        at, table = None, None
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                if at is None or at[:2] != (r.stream, r.run):
                    fresh = r.pkt == (r.run * reset_every if reset_every else 0)
                    table = coding.uniform_counts(n_sym) if fresh else None
                elif r.pkt != at[2] + 1:
                    table = None
                at = r.stream, r.run, r.pkt
                if table is None:
                    continue
                try:
                    got = [s for s, _ in coding.rans_unpacked(bytes(r.bytes), [(c, 0) for c in channels], [coding.cumulative([1 + n for n in table])], n_ch, None, lsh=lsh, state_bytes=4)]
                except ValueError:
                    table = None
                    continue
                table = np.bincount(got[:cap], minlength=n_sym).tolist()
                out.append(pd.DataFrame({"stream": r.stream, "pkt": r.pkt, "ch": channels, "pos": range(len(got)), "sym": got}))
            if out:
                yield pd.concat(out)

    runs = p.select("stream", "pkt", "bytes", _run(reset_every).alias("run")).repartition("stream", "run").sortWithinPartitions("stream", "run", "pkt")
    return runs.mapInPandas(many, SYMBOL)


def high_passed(x: DataFrame, cfg: FrontEnd = FrontEnd(), span: int = 1 << 16) -> DataFrame:
    """stream, ch, frame, code, hp, by ranges of span frames.

    The running mean is one integer of few values, and a sample moves it monotonically: so a range of samples maps all possible states to a few,
    and is folded without knowing where it starts. The maps of a channel's ranges, a few numbers each, give every range's first state; then the ranges are folded
    again, each from its own. Tasks are ranges, however long a channel is.
    """
    keys = ["stream", "ch", "_range"]
    rows = x.select("stream", "ch", "frame", "code").withColumn("_range", F.floor(F.col("frame") / span))

    def mapped(pdf):
        lows, ends = coding.mean_map(pdf.sort_values("frame").code.tolist(), cfg)
        return pd.DataFrame({k: [pdf[k].iloc[0]] for k in keys} | {"lows": [lows], "ends": [ends]})

    last = rows.groupBy("stream", "ch").agg(F.max("_range").alias("_last"))
    before = rows.join(last, ["stream", "ch"]).where("_range < _last").drop("_last")
    maps = before.groupBy(*keys).applyInPandas(mapped, "stream long, ch int, _range long, lows array<long>, ends array<long>")
    through = lambda a, m: F.get(m["ends"], F.size(F.filter(m["lows"], lambda low: low <= a)) - 1)
    begin = F.struct(F.lit(coding.mean_start(cfg)).cast("long").alias("at"), F.array().cast("array<struct<_range:bigint,start:bigint>>").alias("all"))
    step = lambda a, m: (lambda to: F.struct(to.alias("at"), F.array_append(a["all"], F.struct((m["_range"] + 1).alias("_range"), to.alias("start"))).alias("all")))(through(a["at"], m))
    chain = maps.groupBy("stream", "ch").agg(F.array_sort(F.collect_list(F.struct("_range", "lows", "ends"))).alias("m"))
    starts = chain.select("stream", "ch", F.inline(F.aggregate("m", begin, step)["all"]))

    def ranged(pdf):
        pdf = pdf.sort_values("frame")
        first = pdf.start.iloc[0]
        pdf["hp"] = coding.high_pass(pdf[["code"]].to_numpy(), cfg, None if pd.isna(first) else np.array([int(first)]))[0][:, 0]
        return pdf[["stream", "ch", "frame", "code", "hp"]]

    # a range that follows a gap of whole ranges starts where the last one before it has ended
    w = Window.partitionBy("stream", "ch").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    known = rows.select(*keys).distinct().join(starts, keys, "full").withColumn("start", F.last("start", True).over(w))
    return rows.join(known, keys).groupBy(*keys).applyInPandas(ranged, "stream long, ch int, frame long, code long, hp long")


def thresholds(hp: DataFrame, k: float = 4.5) -> DataFrame:
    """stream, ch, thr: exact median of the magnitude, scaled to a deviation."""
    thr = F.greatest(F.lit(1), F.bround(k * F.median(F.abs("hp")) / 0.6745, 0).cast("long"))
    return hp.groupBy("stream", "ch").agg(thr.alias("thr"))


def islands(t: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """t with island: rows of its keys whose frames are more than reach apart from the frame before begin a new one."""
    w = Window.partitionBy(*keys).orderBy("frame")
    begins = F.coalesce(F.col("frame") - F.lag("frame").over(w) > reach, F.lit(True))
    return t.withColumn("_begins", begins.cast("long")).withColumn("island", F.sum("_begins").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_begins")


def spikes(hp: DataFrame, thr: DataFrame, cfg: FrontEnd = FrontEnd()) -> DataFrame:
    """stream, ch, frame of each spike; only the samples below the threshold are folded, each island of them on its own."""
    low = hp.join(thr, ["stream", "ch"]).where(F.col("hp") <= -F.col("thr")).select("stream", "ch", "frame")

    def first(frames: pd.Series) -> pd.Series:
        return pd.Series([coding.after_dead_time(sorted(f), cfg.refractory) for f in frames])

    each = islands(low, ["stream", "ch"], cfg.refractory).groupBy("stream", "ch", "island").agg(F.collect_list("frame").alias("frames"))
    return each.select("stream", "ch", F.explode(F.pandas_udf(first, "array<long>")("frames")).alias("frame"))


def matched_spikes(a: DataFrame, b: DataFrame, reach: int = 10) -> DataFrame:
    """Spikes (stream, ch, frame) a against b: stream, ch, orig, hits, false_pos, distance. Each of a, in order, takes the first free one of b within reach.

    Spikes further apart than reach cannot meet, so every island of both is matched on its own.
    """

    def counts(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([coding.matched(sorted(p), sorted(q), reach) for p, q in zip(x, y, strict=True)], columns=["hits", "extra", "far"])

    both = a.select("stream", "ch", "frame", F.lit(True).alias("_a")).unionByName(b.select("stream", "ch", "frame", F.lit(False).alias("_a")))
    of = lambda c: F.collect_list(F.when(c, F.col("frame")))
    each = islands(both, ["stream", "ch"], reach).groupBy("stream", "ch", "island").agg(of(F.col("_a")).alias("x"), of(~F.col("_a")).alias("y"))
    m = each.select("stream", "ch", F.size("x").alias("n"), F.pandas_udf(counts, "hits long, extra long, far long")("x", "y").alias("m"))
    return m.groupBy("stream", "ch").agg(F.sum("n").alias("orig"), F.sum("m.hits").alias("hits"), F.sum("m.extra").alias("false_pos"), F.sum("m.far").alias("distance"))


def binned(x: DataFrame, spk: DataFrame, frames: int = 400, most: int = 7) -> DataFrame:
    """stream, pkt, ch, n: spikes of each bin, saturated; bins without spikes included."""
    grid = packets(x, frames).select("stream", "pkt", "ch").distinct()
    n = spk.withColumn("pkt", F.floor(F.col("frame") / frames)).groupBy("stream", "pkt", "ch").agg(F.least(F.count("*"), F.lit(most)).alias("n"))
    return grid.join(n, ["stream", "pkt", "ch"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def band_power(hp: DataFrame, frames: int = 400, shift: int = 6, bits: int = 8, floor: int = 0, metric: str = "abs") -> DataFrame:
    """stream, pkt, ch, value."""
    if metric not in ("abs", "square"):
        raise ValueError(metric)
    m = F.abs("hp") if metric == "abs" else F.col("hp") * F.col("hp")
    v = F.least(F.shiftright(F.sum(m), shift), F.lit((1 << bits) - 1))
    out = packets(hp, frames).groupBy("stream", "pkt", "ch").agg(v.alias("value"))
    return out.withColumn("value", F.when(F.col("value") < floor, 0).otherwise(F.col("value")).cast("long"))


def feature_packets(features: DataFrame, value: str, mode: int) -> DataFrame:
    """Packets of mode 2 (counts) or 3 (band power) from one row for each packet and channel."""
    make = coding.spike_packet if mode == 2 else coding.band_packet

    def one(pdf):
        s, k = int(pdf.stream.iloc[0]), int(pdf.pkt.iloc[0])
        return pd.DataFrame([(s, k, mode, k & 63, make(pdf.sort_values("ch")[value].tolist(), k))], columns=["stream", "pkt", "mode", "seq", "bytes"])

    return features.groupBy("stream", "pkt").applyInPandas(one, PACKETS)


def lossy_packets(x: DataFrame, n_ch: int, cfg: LossyConfig = LossyConfig(), tables=None) -> tuple[DataFrame, list[list[int]]]:
    sym = whole_packets(wavelet.symbols(blocks(x, cfg.block), cfg), n_ch, cfg)
    tables = tables or trained_tables(sym, cfg)
    return encode_lossy(sym, tables, n_ch, cfg), tables
