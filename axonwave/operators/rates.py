"""The rate table of all modes on a recording: calibrated on its first part, measured on the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonwave.functions.coding import RiceConfig
from axonwave.operators import codecs, wavelet
from axonwave.operators.wavelet import LossyConfig
from axonwave.plans.samples import blocks, packets

#: frames of a packet of modes 2 and 3, and bits of their features as they are
BIN_FRAMES, FEATURE_BITS = 400, {2: 3, 3: 8}


def calibrated(x: DataFrame, first: int) -> tuple[DataFrame, DataFrame]:
    """(the first frames of every stream, the others, counted from 0)."""
    return x.where(F.col("frame") < first), x.where(F.col("frame") >= first).withColumn("frame", F.col("frame") - first)


def mode_rates(x: DataFrame, n_ch: int, first: int, rate: float, k: float = 4.5, cfg: LossyConfig = LossyConfig()) -> DataFrame:
    """mode, packets, n_bytes, samples, bps, vs_10, vs_16, vs_feature, note of each mode over samples(stream, ch, frame, code).

    The tables of mode 1 and the thresholds of mode 2 come from the first frames; nothing that is measured has been seen. vs_10, vs_16: compression against 10-bit samples and
    16-bit files; vs_feature: of modes 2 and 3, against their features uncoded. note: 0, the share of samples that decode to themselves; 1, the SNR in dB; 2, spikes a second
    and channel at rate frames a second; 3, the share of features above zero. A mode without a whole packet has no row.
    """
    cal, rest = calibrated(x, first)
    tables = codecs.trained_tables(wavelet.symbols(blocks(cal, cfg.block), cfg), cfg)
    hp = codecs.high_passed(rest)
    spk = codecs.spikes(hp, codecs.thresholds(codecs.high_passed(cal), k))
    counts, power = codecs.binned(rest, spk, BIN_FRAMES), codecs.band_power(hp, BIN_FRAMES)
    rice, lossy = codecs.encode_lossless(rest), codecs.lossy_packets(rest, n_ch, cfg, tables)[0]

    exact = packets(rest, RiceConfig().frames).join(codecs.decode_lossless(rice, n_ch).withColumnRenamed("code", "y"), ["stream", "ch", "frame"], "left")
    exact = exact.agg(F.avg(F.col("code").eqNullSafe(F.col("y")).cast("double")).alias("note"))
    y = codecs.decode_lossy(lossy, tables, n_ch, cfg).join(blocks(rest, cfg.block).select("stream", "ch", "blk", "p", "code"), ["stream", "ch", "blk", "p"])
    mean = y.groupBy("stream", "ch").agg(F.avg("code").alias("mean"))
    ratio = F.try_divide(F.sum((F.col("code") - F.col("mean")) ** 2), F.sum((F.col("y") - F.col("code")) ** 2))
    snr = y.join(mean, ["stream", "ch"]).agg((10 * F.log10(ratio)).alias("note"))
    hits = counts.agg(F.try_divide(F.sum("n") * rate, F.count("*") * BIN_FRAMES).alias("note"))
    above = power.agg(F.avg((F.col("value") > 0).cast("double")).alias("note"))

    out = None
    for mode, p, frames, note in (
        (0, rice, RiceConfig().frames, exact), (1, lossy, cfg.frames, snr), (2, codecs.feature_packets(counts, "n", 2), BIN_FRAMES, hits), (3, codecs.feature_packets(power, "value", 3), BIN_FRAMES, above)):
        one = p.agg(F.count("*").alias("packets"), F.sum(F.length("bytes")).alias("n_bytes")).where("packets > 0")
        one = one.join(F.broadcast(note))  # one row each
        bits, samples = 8 * F.col("n_bytes"), F.col("packets") * frames * n_ch
        feature = F.lit(FEATURE_BITS[mode]) * F.col("packets") * n_ch / bits if mode in FEATURE_BITS else F.lit(None).cast("double")
        one = one.select(F.lit(mode).alias("mode"), "packets", "n_bytes", samples.alias("samples"), (bits / samples).alias("bps"), (10 * samples / bits).alias("vs_10"), (16 * samples / bits).alias("vs_16"), feature.alias("vs_feature"), "note")
        out = one if out is None else out.unionByName(one)
    return out
