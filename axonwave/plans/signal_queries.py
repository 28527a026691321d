"""Queries of ingest, shaping, wavelet, coding and quality."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from axonwave.functions import coding
from axonwave.operators import codecs, wavelet
from axonwave.operators.codecs import high_passed, spikes, thresholds
from axonwave.operators.folds import carried
from axonwave.plans.packet_sql import LOSSY_CODED, RAW_CDF, bits_hex, rans_hex, rice_hex
from axonwave.plans.samples import BLOCKS_SQL, SQL, blocks, packets, packets_sql, samples, table
from axonwave.sources.folders import new_folder
from axonwave.streaming import coder

N = 8
FWD, SYM = wavelet.forward_sql(), wavelet.SYMBOLS_SQL
BASE = f"WITH {SQL}, {BLOCKS_SQL}, {FWD}"
HP_SQL = f"""WITH RECURSIVE {SQL}, hp AS (SELECT ch, 0::BIGINT AS frame, code, code - (4096 >> 3) AS hp, 4096 + code - (4096 >> 3) AS acc FROM s WHERE frame = 0
    UNION ALL SELECT s.ch, s.frame, s.code, s.code - (hp.acc >> 3), hp.acc + s.code - (hp.acc >> 3) FROM hp JOIN s ON s.ch = hp.ch AND s.frame = hp.frame + 1)"""
THR_SQL = "th AS (SELECT ch, greatest(1, round_even(4.5 * median(abs(hp)) / 0.6745, 0)::BIGINT) AS thr FROM hp GROUP BY ch)"


def samples_summary(spark, d):
    return samples(spark, d).groupBy("ch").agg(F.count("*").alias("n"), F.min("code").alias("lo"), F.max("code").alias("hi"), F.sum("code").alias("total"))


def slot_selection(spark, d):
    """Selected slots of a slot stream, as channels in ascending slot order."""
    slots = [3, 40, 41, 90, 128, 149]
    sel = spark.createDataFrame(list(zip(range(len(slots)), slots, strict=True)), "ch int, slot int")
    e = table(spark, d, "events").select(F.pmod("user_id", F.lit(256)).cast("int").alias("slot"), F.bround("value", 0).cast("long").alias("code"))
    return e.join(F.broadcast(sel), "slot").groupBy("ch").agg(F.count("*").alias("n"), F.sum("code").alias("total"))


def _gapped(spark, d):
    e = samples(spark, d)
    return e.where(F.pmod(F.col("frame") * 7 + F.col("ch"), F.lit(5)) != 0)


def locf_repair(spark, d):
    """Missing slots repeat the last sample of their channel, 512 before the first."""
    have = _gapped(spark, d)
    last = have.groupBy("stream", "ch").agg(F.max("frame").alias("m"))
    grid = last.select("stream", "ch", F.explode(F.sequence(F.lit(0).cast("long"), "m")).alias("frame"))
    w = Window.partitionBy("stream", "ch").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    out = grid.join(have, ["stream", "ch", "frame"], "left").withColumn("code", F.coalesce(F.last("code", True).over(w), F.lit(512)))
    return out.groupBy("ch").agg(F.count("*").alias("n"), F.sum("code").alias("total"), F.sum(F.col("code") * F.pmod("frame", F.lit(97))).alias("mixed"))


def aborted_packets(spark, d):
    """Packets with a short frame are lost whole: packets of 256 frames and how many of their frames are short."""
    have = _gapped(spark, d).where("pmod(frame, 700) < 300")
    f = samples(spark, d).groupBy("stream", "frame").agg(F.count("*").alias("want")).join(have.groupBy("stream", "frame").agg(F.count("*").alias("got")), ["stream", "frame"], "left")
    f = f.withColumn("short", F.coalesce("got", F.lit(0)) < F.col("want") - 2)
    return f.groupBy(F.floor(F.col("frame") / 256).alias("pkt")).agg(F.sum(F.col("short").cast("long")).alias("short"), F.max("short").alias("aborted"))


def dwt_bands(spark, d):
    c = wavelet.coefficients(blocks(samples(spark, d)))
    return c.groupBy("ch", "ctx").agg(F.count("*").alias("n"), F.sum("c").alias("total"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.sum(F.col("c") * F.col("i")).alias("mixed"))


def dwt_symbol_histogram(spark, d):
    return wavelet.symbols(blocks(samples(spark, d))).groupBy("ctx", "sym").agg(F.count("*").alias("n"))


def symbol_histogram_pooled(spark, d):
    s = wavelet.symbols(blocks(samples(spark, d)))
    return s.groupBy("sym").agg(F.count("*").alias("n"), F.sum((F.col("sym") == 63).cast("long")).alias("escapes"))


def dwt_roundtrip(spark, d):
    b = wavelet.inverse(wavelet.forward(blocks(samples(spark, d))))
    return b.groupBy("ch").agg(F.count("*").alias("n"), F.sum((F.col("x") != F.col("code")).cast("long")).alias("wrong"))


def lossy_reconstruction(spark, d):
    r = wavelet.reconstruction(blocks(samples(spark, d)))
    e = F.col("y") - F.col("code")
    return r.groupBy("ch").agg(F.count("*").alias("n"), F.sum(e * e).alias("sq_err"), F.max(F.abs(e)).alias("max_err"), F.sum("y").alias("total"))


def burst_schedule(spark, d):
    """Symbols that each frame of a block has given rise to, over all blocks of a channel: a burst follows the frame that completes a coefficient."""
    c = wavelet.coefficients(blocks(samples(spark, d)))
    level = F.when(F.col("ctx") == 0, 3).otherwise(F.col("ctx"))
    at = F.least(F.lit(63), F.pow(F.lit(2), level).cast("long") * (F.col("i") + 2) - 2).cast("int")
    return c.groupBy("ch", at.alias("t")).agg(F.count("*").alias("n"), F.count_if(F.col("q") != 0).alias("nonzero"))


def coding_positions(spark, d):
    s = wavelet.symbols(blocks(samples(spark, d)))
    return s.groupBy("pkt").agg(F.count("*").alias("n"), F.sum(F.col("pos") * (F.col("sym") + 1)).alias("mixed"), F.sum(F.col("pos") * F.col("ch")).alias("chs"))


def entropy_bits(spark, d):
    n = wavelet.symbols(blocks(samples(spark, d))).groupBy("ctx", "sym").agg(F.count("*").alias("n"))
    t = n.withColumn("t", F.sum("n").over(Window.partitionBy("ctx")))
    return t.groupBy("ctx").agg(F.sum("n").alias("n"), F.round(-F.sum(F.col("n") * F.log2(F.col("n") / F.col("t"))), 4).alias("bits"))


def trained_cdf(spark, d):
    t = codecs.trained_tables(wavelet.symbols(blocks(samples(spark, d))))
    rows = [(k, s, x[s + 1] - x[s], x[s]) for k, x in enumerate(t) for s in range(len(x) - 1)]
    return spark.createDataFrame(rows, "ctx int, sym int, f long, c long")


def static_code_length(spark, d):
    """Ideal bits of the symbols under the trained tables, escapes with 10 bits more and 42 bits of state a channel."""
    s = wavelet.symbols(blocks(samples(spark, d)))
    cdf = trained_cdf(spark, d)
    b = s.join(F.broadcast(cdf), ["ctx", "sym"]).groupBy("ch").agg(F.sum(-F.log2(F.col("f") / 4096) + F.when(F.col("sym") == 63, 10).otherwise(0)).alias("b"), F.count("*").alias("n"))
    return b.select("ch", "n", F.round(F.col("b") + 42, 4).alias("bits"))


def slot_lookup_range(spark, d):
    """Table slots to symbols: the symbol whose range [c, c + f) holds the slot."""
    cdf = F.broadcast(trained_cdf(spark, d))
    slots = spark.range(4096).select(F.col("id").alias("slot"))
    full = slots.join(cdf, (F.col("slot") >= F.col("c")) & (F.col("slot") < F.col("c") + F.col("f")))
    return full.groupBy("ctx").agg(F.count("*").alias("n"), F.count_distinct("sym").alias("syms"), F.sum(F.col("slot") * F.col("sym")).alias("mixed"))


def cross_fit(spark, d):
    """Bits of each half of the blocks under the counts (plus a half) of the other."""
    s = wavelet.symbols(blocks(samples(spark, d))).withColumn("fold", F.pmod("blk", F.lit(2)))
    n = s.groupBy("fold", "ctx", "sym").agg(F.count("*").alias("n"))
    t = n.groupBy("fold", "ctx").agg(F.sum("n").alias("t"))
    o = n.select((1 - F.col("fold")).alias("fold"), "ctx", "sym", F.col("n").alias("m"))
    o_t = t.select((1 - F.col("fold")).alias("fold"), "ctx", F.col("t").alias("mt"))
    b = n.join(o_t, ["fold", "ctx"]).join(o, ["fold", "ctx", "sym"], "left").withColumn("b", -F.col("n") * F.log2((F.coalesce("m", F.lit(0)) + 0.5) / (F.col("mt") + 32)))
    return b.groupBy("fold").agg(F.sum("n").alias("n"), F.round(F.sum("b"), 4).alias("bits"))


def rice_static_bits(spark, d):
    """Scalar functions of the lossless coder: wrapped difference, zigzag, parameter, code length."""
    w = Window.partitionBy("stream", "pkt", "ch").orderBy("frame")
    k = packets(samples(spark, d), 128).withColumn("e0", F.col("code") - F.lag("code").over(w)).where("e0 IS NOT NULL")
    k = k.withColumn("e", F.pmod(F.col("e0") + 512, F.lit(1024)) - 512)
    k = k.withColumn("m", wavelet.zigzag(F.col("e")))
    a = F.abs("e") + 1
    sel = sum([F.when(F.shiftleft(F.lit(4).cast("long"), i) < a, 1).otherwise(0) for i in range(9)], F.lit(0))
    k = k.withColumn("k", F.least(F.lit(9), sel))
    q = F.floor(F.col("m") / F.pow(F.lit(2), F.col("k"))).cast("long")
    bits = F.when(q < 16, q + 1 + F.col("k")).otherwise(26)
    return k.groupBy("ch").agg(F.count("*").alias("n"), F.sum("m").alias("m"), F.sum("k").cast("long").alias("k"), F.sum(bits).cast("long").alias("bits"), F.sum((wavelet.unzigzag(F.col("m")) != F.col("e")).cast("long")).alias("wrong"))


def rice_adaptive_bits(spark, d):
    def one(pdf):
        n = sum(o + c + b for o, c, _, b in coding.rice_words(pdf.sort_values("frame").code.tolist()))
        return pd.DataFrame({"pkt": [int(pdf.pkt.iloc[0])], "ch": [int(pdf.ch.iloc[0])], "bits": [n]})

    return packets(samples(spark, d), 128).groupBy("pkt", "ch").applyInPandas(one, "pkt long, ch int, bits long")


RICE_SQL = f"""WITH RECURSIVE {SQL}, {packets_sql(128)},
z AS (SELECT pkt, ch, frame % 128 AS i, code, coalesce(((code - lag(code) OVER (PARTITION BY pkt, ch ORDER BY frame) + 1536) % 1024) - 512, 0) AS e FROM k),
r(pkt, ch, i, a, n, bits) AS (SELECT pkt, ch, 0::BIGINT, 16::BIGINT, 1::BIGINT, 10::BIGINT FROM z WHERE i = 0
  UNION ALL SELECT pkt, ch, i, CASE WHEN n = 63 THEN (a + abs(e)) >> 1 ELSE a + abs(e) END, CASE WHEN n = 63 THEN 32 ELSE n + 1 END,
    bits + CASE WHEN (m >> kk) < 16 THEN (m >> kk) + 1 + kk ELSE 26 END
  FROM (SELECT z.pkt, z.ch, z.i, z.e, r.a, r.n, r.bits, CASE WHEN z.e >= 0 THEN 2 * z.e ELSE -2 * z.e - 1 END AS m,
    ({' + '.join(f'CASE WHEN (r.n << {j}) < r.a THEN 1 ELSE 0 END' for j in range(9))})::BIGINT AS kk FROM r JOIN z ON z.pkt = r.pkt AND z.ch = r.ch AND z.i = r.i + 1))
SELECT pkt, ch, bits FROM r WHERE i = 127"""


def _fingerprint(p):
    return p.select("pkt", "mode", "seq", F.length("bytes").cast("long").alias("n_bytes"), F.sha2("bytes", 256).alias("sha"))


def lossless_packets(spark, d):
    return _fingerprint(codecs.encode_lossless(samples(spark, d)))


def lossless_roundtrip(spark, d):
    x = samples(spark, d)
    y = codecs.decode_lossless(codecs.encode_lossless(x), N).withColumnRenamed("code", "y")
    j = packets(x, 128).join(y, ["stream", "ch", "frame"], "left")
    return j.groupBy("ch").agg(F.count("*").alias("n"), F.sum((~F.col("code").eqNullSafe(F.col("y"))).cast("long")).alias("wrong"))


def lossy_packets(spark, d):
    return _fingerprint(codecs.lossy_packets(samples(spark, d), N)[0])


def lossy_roundtrip(spark, d):
    """Decoded samples against the transform path without entropy coding."""
    x = samples(spark, d)
    p, tables = codecs.lossy_packets(x, N)
    y = codecs.decode_lossy(p, tables, N).withColumnRenamed("y", "z")
    r = wavelet.reconstruction(blocks(x)).join(y, ["stream", "ch", "blk", "p"])
    return r.groupBy("ch").agg(F.count("*").alias("n"), F.sum((F.col("y") != F.col("z")).cast("long")).alias("wrong"))


LOSSLESS_SQL = f"""WITH RECURSIVE {SQL}, {packets_sql(128)}, q AS (SELECT pkt, ch, frame % 128 AS i, code FROM k), {rice_hex("q", "")}
SELECT pkt, 0::INT AS mode, (pkt % 64)::INT AS seq, length(packet) // 2 AS n_bytes, sha256(unhex(packet)) AS sha FROM rice_hex"""
ADAPTIVE_SQL = f"""{BASE.replace("WITH", "WITH RECURSIVE", 1)}, {SYM}, po AS (SELECT pkt, ch, sym, row_number() OVER (PARTITION BY pkt ORDER BY blk, at_, ch, turn) - 1 AS pos, count(*) OVER (PARTITION BY pkt) AS n FROM sm),
    w AS (SELECT * FROM po WHERE n = 2048), n AS (SELECT pkt, sym, count(*) AS n FROM w WHERE pos < 4032 GROUP BY ALL),
    g AS (SELECT pkt, s AS sym, 1 + coalesce(n.n, 0) AS f FROM (SELECT DISTINCT pkt FROM w), range(64) r(s) LEFT JOIN (SELECT pkt + 1 AS p, sym AS y, n FROM n) n ON n.p = pkt AND n.y = s),
    ta AS (SELECT pkt, sym, f, (sum(f) OVER (PARTITION BY pkt ORDER BY sym) - f)::BIGINT AS c, (sum(f) OVER (PARTITION BY pkt))::BIGINT AS m FROM g),
    wt AS (SELECT w.pkt, w.ch, w.pos, ta.f, ta.c, ta.m, '' AS raw FROM w JOIN ta ON w.pkt = ta.pkt AND w.sym = ta.sym), {rans_hex("wt", 11, 8, 4)}
    SELECT pkt, length(packet) // 2 AS n_bytes, sha256(unhex(packet)) AS sha, 0::BIGINT AS wrong FROM rans_hex"""
RENORM_SQL = f"""{LOSSY_CODED}, un(u) AS (VALUES (8), (4), (2), (1)), ry AS (SELECT ly.*, u, row_number() OVER (PARTITION BY pkt, ch, u ORDER BY pos) AS i FROM ly, un),
    rr(pkt, ch, u, i, x, bits) AS (SELECT DISTINCT pkt, ch, u, 0::BIGINT, (4096 << 2)::BIGINT, 0::BIGINT FROM ry
        UNION ALL SELECT pkt, ch, u, i, ((x >> u * n) // f) * 4096 + (x >> u * n) % f + c, bits + u * n + 4 * length(raw)
        FROM (SELECT *, {' + '.join(f"CASE WHEN u * {k} < 40 AND (x >> least(u * {k}, 40)) >= (f << 2 + u) THEN 1 ELSE 0 END" for k in range(24))} AS n
            FROM (SELECT ry.pkt, ry.ch, ry.u, ry.i, rr.x, rr.bits, ry.f, ry.c, ry.raw FROM rr JOIN ry ON ry.pkt = rr.pkt AND ry.ch = rr.ch AND ry.u = rr.u AND ry.i = rr.i + 1)))
    SELECT pkt, u::INT AS unit, (sum(bits) + 8 * (14 + u))::BIGINT AS bits FROM (SELECT * FROM rr QUALIFY row_number() OVER (PARTITION BY pkt, ch, u ORDER BY i DESC) = 1) GROUP BY pkt, u"""
LOSSY_SQL = f"""{LOSSY_CODED} SELECT pkt, 1::INT AS mode, (pkt % 64)::INT AS seq, length(packet) // 2 + 1 AS n_bytes, sha256(unhex(printf('%02X', (64 + pkt % 64)::INT) || packet)) AS sha FROM rans_hex"""
LOSSY_ROUND_SQL = f"{BASE}, sz AS (SELECT blk // 4 AS pkt, count(*) AS n FROM b GROUP BY 1) SELECT ch, count(*) AS n, 0::BIGINT AS wrong FROM b WHERE blk // 4 IN (SELECT pkt FROM sz WHERE n = 2048) GROUP BY ch"


def high_pass(spark, d):
    return high_passed(samples(spark, d)).groupBy("ch").agg(F.sum("hp").alias("total"), F.min("hp").alias("lo"), F.max("hp").alias("hi"), F.sum(F.abs("hp")).alias("mag"))


def spike_thresholds(spark, d):
    return thresholds(high_passed(samples(spark, d))).select("ch", "thr")


def _spikes(spark, d, k=1.0):
    hp = high_passed(samples(spark, d))
    return hp, spikes(hp, thresholds(hp, k))


def spike_counts(spark, d):
    return _spikes(spark, d)[1].groupBy("ch").agg(F.count("*").alias("n"), F.sum("frame").alias("frames"))


SPIKES_SQL = f"""{HP_SQL}, {THR_SQL.replace('4.5', '1.0')}, cand AS (SELECT hp.ch, frame, row_number() OVER (PARTITION BY hp.ch ORDER BY frame) AS k FROM hp JOIN th USING (ch) WHERE hp <= -thr),
sp(ch, k, frame, last, keep) AS (SELECT ch, k, frame, frame, true FROM cand WHERE k = 1
  UNION ALL SELECT c.ch, c.k, c.frame, CASE WHEN c.frame - sp.last > 20 THEN c.frame ELSE sp.last END, c.frame - sp.last > 20 FROM sp JOIN cand c ON c.ch = sp.ch AND c.k = sp.k + 1)"""


def spike_bins(spark, d):
    _, spk = _spikes(spark, d)
    return codecs.binned(samples(spark, d), spk).select("pkt", "ch", "n")


def band_power(spark, d):
    return codecs.band_power(high_passed(samples(spark, d))).select("pkt", "ch", "value")


def spike_bin_packets(spark, d):
    _, spk = _spikes(spark, d)
    return _fingerprint(codecs.feature_packets(codecs.binned(samples(spark, d), spk), "n", 2))


def band_power_packets(spark, d):
    return _fingerprint(codecs.feature_packets(codecs.band_power(high_passed(samples(spark, d))), "value", 3))


def snr_per_channel(spark, d):
    r = wavelet.reconstruction(blocks(samples(spark, d)))
    m = r.groupBy("ch").agg(F.avg("code").alias("mean"))
    t = r.join(F.broadcast(m), "ch").groupBy("ch").agg(F.sum(F.pow(F.col("code") - F.col("mean"), 2)).alias("s"), F.sum(F.pow(F.col("y") - F.col("code"), 2)).alias("e"))
    return t.select("ch", F.round(10 * F.log10(F.col("s") / F.greatest(F.col("e"), F.lit(1e-9))), 6).alias("snr"))


def snr_pooled(spark, d):
    r = wavelet.reconstruction(blocks(samples(spark, d)))
    m = r.groupBy("ch").agg(F.avg("code").alias("mean"))
    t = r.join(F.broadcast(m), "ch").agg(F.sum(F.pow(F.col("code") - F.col("mean"), 2)).alias("s"), F.sum(F.pow(F.col("y") - F.col("code"), 2)).alias("e"))
    return t.select(F.round(10 * F.log10(F.col("s") / F.col("e")), 6).alias("snr"))


def snr_percentiles(spark, d):
    return snr_per_channel(spark, d).agg(F.round(F.median("snr"), 6).alias("median"), F.round(F.percentile("snr", F.lit(0.1)), 6).alias("p10"), F.min("snr").alias("lo"))


SNR_SQL = f"""{BASE}, {wavelet.RECON_SQL}, {wavelet.inverse_sql('dq', 'd')}, rc AS (SELECT ch, code, greatest(0, least(1023, x)) AS y FROM rx),
mm AS (SELECT ch, avg(code) AS mean FROM rc GROUP BY ch), t AS (SELECT ch, sum((code - mean) ** 2) AS s, sum(((y - code) ** 2)::DOUBLE) AS e FROM rc JOIN mm USING (ch) GROUP BY ch),
snr AS (SELECT ch, round(10 * log10(s / greatest(e, 1e-9)), 6) AS snr FROM t)"""


def spike_match(spark, d):
    """Spikes of the original against those of the reconstruction, thresholds from the original."""
    b = blocks(samples(spark, d))
    r = wavelet.reconstruction(b).withColumn("frame", F.col("blk") * 64 + F.col("p"))
    a = high_passed(r.select("stream", "ch", "frame", "code"))
    thr = thresholds(a, 1.0)
    z = high_passed(r.select("stream", "ch", "frame", F.col("y").alias("code")))
    return codecs.matched_spikes(spikes(a, thr), spikes(z, thr)).drop("stream")


#: Greedy matching as a walk over both lists of spikes.
MATCH_SQL = f"""{BASE.replace('WITH', 'WITH RECURSIVE', 1)}, {wavelet.RECON_SQL}, {wavelet.inverse_sql('dq', 'd')}, z AS (SELECT ch, 'a' AS w, blk * 64 + p AS frame, code AS v FROM rx UNION ALL SELECT ch, 'b', blk * 64 + p, greatest(0, least(1023, x)) FROM rx),
h AS (SELECT ch, w, 0::BIGINT AS frame, v - (4096 >> 3) AS hp, 4096 + v - (4096 >> 3) AS acc FROM z WHERE frame = 0
    UNION ALL SELECT z.ch, z.w, z.frame, z.v - (h.acc >> 3), h.acc + z.v - (h.acc >> 3) FROM h JOIN z ON z.ch = h.ch AND z.w = h.w AND z.frame = h.frame + 1),
th AS (SELECT ch, greatest(1, round_even(1.0 * median(abs(hp)) / 0.6745, 0)::BIGINT) AS thr FROM h WHERE w = 'a' GROUP BY ch),
lo AS (SELECT h.ch, w, frame, row_number() OVER (PARTITION BY h.ch, w ORDER BY frame) AS i FROM h JOIN th ON h.ch = th.ch WHERE hp <= -thr),
rf(ch, w, i, last, keep) AS (SELECT ch, w, i, frame, true FROM lo WHERE i = 1 UNION ALL SELECT lo.ch, lo.w, lo.i, CASE WHEN frame - last > 20 THEN frame ELSE last END, frame - last > 20 FROM rf JOIN lo ON lo.ch = rf.ch AND lo.w = rf.w AND lo.i = rf.i + 1),
li AS (SELECT ch, coalesce(list(last ORDER BY last) FILTER (w = 'a'), []) AS a, coalesce(list(last ORDER BY last) FILTER (w = 'b'), []) AS b FROM rf WHERE keep GROUP BY ch),
wk(ch, i, j, hits, far) AS (SELECT ch, 1::BIGINT, 1::BIGINT, 0::BIGINT, 0::BIGINT FROM li UNION ALL SELECT wk.ch, CASE WHEN b[j] < a[i] - 10 THEN i ELSE i + 1 END, CASE WHEN b[j] > a[i] + 10 THEN j ELSE j + 1 END,
    hits + CASE WHEN abs(a[i] - b[j]) <= 10 THEN 1 ELSE 0 END, far + CASE WHEN abs(a[i] - b[j]) <= 10 THEN abs(a[i] - b[j]) ELSE 0 END FROM wk JOIN li ON li.ch = wk.ch WHERE i <= len(a) AND j <= len(b))
SELECT li.ch, any_value(len(a)) AS orig, max(hits) AS hits, any_value(len(b)) - max(hits) AS false_pos, max(far) AS distance FROM wk JOIN li ON li.ch = wk.ch GROUP BY li.ch"""


def value_range(spark, d):
    c = wavelet.coefficients(blocks(samples(spark, d)))
    return c.groupBy("ctx").agg(F.max(F.abs("c")).alias("most"), (F.ceil(F.log2(F.max(F.abs("c")) + 1.0)) + 1).cast("long").alias("bits"))


def bits_per_sample(spark, d):
    x = samples(spark, d)
    p = codecs.encode_lossless(x)
    n = packets(x, 128).count()
    return p.agg(F.sum(F.length("bytes")).alias("n_bytes"), F.round(8 * F.sum(F.length("bytes")) / n, 6).alias("bps"))


def worst_packets(spark, d):
    """Top 10 of packet and channel by adaptive bits."""
    return rice_adaptive_bits(spark, d).orderBy(F.desc("bits"), "pkt", "ch").limit(10)


def file_quantiser(spark, d):
    """Step of a quantised signal from the gaps of its values, and its codes, checked to be one to one."""
    v = table(spark, d, "events").select((F.bround("value", 0).cast("long") * 64 - 32768).alias("x"))
    u = v.distinct()
    g = u.withColumn("gap", F.col("x") - F.lag("x").over(Window.orderBy("x"))).where("gap IS NOT NULL")  # rows: levels, 2**16 at most
    med = g.agg((1.5 * F.median("gap")).alias("m"))
    near = g.join(F.broadcast(med), F.col("gap") < F.col("m")).agg(F.avg("gap").alias("mean"))
    span = u.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("levels"))
    s = span.join(F.broadcast(near)).withColumn("step", (F.col("hi") - F.col("lo")) / F.bround((F.col("hi") - F.col("lo")) / F.col("mean"), 0))
    c = u.join(F.broadcast(s)).select("x", "levels", F.bround((F.col("x") - F.col("lo")) / F.col("step"), 0).cast("long").alias("code"))
    return c.agg(F.max("levels").alias("levels"), F.count_distinct("code").alias("codes"), F.max("code").alias("top"), F.sum("code").alias("total"))


def ramp_stimulus(spark, d):
    """How far the recorded samples of each channel are from the test signals: a ramp by slot, mid-scale, full-scale alternation and slow steps."""
    f, c = F.col("frame"), F.col("ch")
    signals = {
        "ramp": (f + 4 * c).bitwiseAND(F.lit(1023).cast("long")), "constant": F.lit(512), "nyquist": F.when(F.pmod(f, F.lit(2)) == 0, 0).otherwise(1023),
        "steps": F.when(F.pmod(F.floor(f / 37), F.lit(2)) == 0, 0).otherwise(1023)}
    return samples(spark, d).groupBy("ch").agg(*[F.sum(F.abs(F.col("code") - v)).cast("long").alias(k) for k, v in signals.items()])


def lfsr_values(n: int, seed: int = 0xACE1, taps: int = 0xB400) -> list[int]:
    """Low 10 bits before each step; the period is 65535."""
    out, x = [], seed
    for _ in range(n):
        out.append(x & 1023)
        x = (x >> 1) ^ (taps if x & 1 else 0)
    return out


def _lfsr(spark):
    """The register's whole period: 65535 rows, so it can be broadcast."""
    return F.broadcast(spark.createDataFrame(list(enumerate(lfsr_values(65535))), "at long, noise long"))


def lfsr_stimulus(spark, d):
    """The recorded samples against the register's sequence, one step a frame: bits in common, and what is left of both in a channel."""
    x = samples(spark, d).withColumn("at", F.pmod("frame", F.lit(65535))).join(_lfsr(spark), "at")
    mixed = F.col("code").bitwiseXOR(F.col("noise"))
    return x.groupBy("ch").agg(F.count("*").alias("n"), F.count_if(mixed == 0).alias("equal"), F.sum(10 - F.bit_count(mixed)).cast("long").alias("bits"), F.sum(mixed).alias("total"))


def encode_lfsr(spark, d):
    """Worst case of mode 1: the recorded samples under noise of the register, with tables trained on it."""
    x = samples(spark, d).withColumn("at", F.pmod(F.col("frame") * N + F.col("ch"), F.lit(65535))).join(_lfsr(spark), "at")
    return _fingerprint(codecs.lossy_packets(x.select("stream", "ch", "frame", F.col("code").bitwiseXOR(F.col("noise")).alias("code")), N)[0])


def renorm_sweep(spark, d):
    """Packet bits for renormalisation units of 8, 4, 2 and 1 bits."""
    x = samples(spark, d)
    sym = codecs.whole_packets(wavelet.symbols(blocks(x)), N)
    tables = codecs.trained_tables(sym)
    units = F.broadcast(spark.createDataFrame([(8,), (4,), (2,), (1,)], "unit int"))

    def one(pdf):
        pdf = pdf.sort_values("pos")
        s = [(c, k, y, b"\0\0" if y == 63 else None) for c, k, y in zip(pdf.ch.tolist(), pdf.ctx.tolist(), pdf.sym.tolist(), strict=True)]
        u = int(pdf.unit.iloc[0])
        return pd.DataFrame({"pkt": [int(pdf.pkt.iloc[0])], "unit": [u], "bits": [coding.rans_bits(s, tables, 2, u, N)]})

    return sym.join(units).groupBy("pkt", "unit").applyInPandas(one, "pkt long, unit int, bits long")


def adaptive_rans(spark, d):
    """Packets coded with a table from the packet before (the first with equal frequencies), and decoded from the bytes alone, packet after packet."""
    sym = codecs.whole_packets(wavelet.symbols(blocks(samples(spark, d))), N).select("stream", "pkt", "ch", "pos", F.col("sym").cast("long").alias("sym"))
    p = codecs.encode_adaptive(sym, N)
    back = codecs.decode_adaptive(p, [c for _, c, _, _ in codecs.coding_order(N)], N).withColumnRenamed("sym", "back")
    wrong = sym.join(back, ["stream", "pkt", "ch", "pos"], "full").groupBy("stream", "pkt").agg(F.count_if(~F.col("sym").eqNullSafe(F.col("back"))).alias("wrong"))
    return p.join(wrong, ["stream", "pkt"]).select("pkt", F.length("bytes").cast("long").alias("n_bytes"), F.sha2("bytes", 256).alias("sha"), "wrong")


#: Frames of a channel in a micro-batch of `streamed_packets`, at most.
BATCH = 1 << 17


def streamed_packets(spark, d):
    """Lossless packets from a stream whose coder keeps its state between micro-batches and over a restart. A micro-batch has at most BATCH frames, however many there are."""
    x, at = samples(spark, d), new_folder(spark, "streamed-packets")
    x.withColumn("part", F.floor(F.col("frame") / BATCH)).repartition("part").write.partitionBy("part").parquet(f"{at}/all")
    x = spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in x.schema)}, part long").parquet(f"{at}/all")
    top = x.agg(F.max("frame")).first()[0] or 0
    within = lambda lo, hi: F.col("part").between(lo // BATCH, hi // BATCH) & F.col("frame").between(lo, hi - 1)
    put = lambda lo, hi: x.where(within(lo, hi)).drop("part").coalesce(1).write.mode("append").parquet(f"{at}/in")  # noqa: E731  one file a micro-batch
    x_schema = x.drop("part").schema
    with coder.state_store(spark):
        for cuts in ([0, top // 3], [top // 3, top // 2, top + 1]):
            cuts = sorted([*cuts, *(k for k in range(0, top + 1, BATCH) if cuts[0] < k < cuts[-1] and k not in cuts)])
            for lo, hi in zip(cuts, cuts[1:]):
                put(lo, hi)
            made = coder.streaming_rice(spark.readStream.schema(x_schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in"))
            made.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return _fingerprint(coder.lossless_packets(spark.read.parquet(f"{at}/out"), N))


def lms_residuals(spark, d):
    """Sign-sign LMS prediction of the differences: magnitude of the wrapped residual and samples of each context. Sequential along a channel; its state is carried from batch to batch."""
    import numpy as np

    first, step = np.array(LMS_START), np.array(LMS_STEP)

    def along(state, rows):
        last, w, past, acc, mag, total, ctx = state
        ctx = list(ctx)
        for x in rows.code.tolist():
            if last is not None:
                diff = x - last
                r = diff + int((past * w).sum() >> 12)
                w = np.clip(w - np.sign(past) * (1 if r > 0 else -1) * step, -8192, 8192)
                past = np.concatenate([[diff], past[:-1]])
                avg = max(1, acc >> 17)
                ctx[(mag >= avg) + (mag >= 3 * avg) + (mag >= 5 * avg)] += 1
                mag = abs((r + 512) % 1024 - 512)
                acc += mag - (acc >> 17)
                total += mag
            last = x
        return (last, w, past, acc, mag, total, ctx), None

    start = lambda: (None, first, np.zeros(8, np.int64), 30 << 17, 0, 0, [0] * 4)
    end = lambda key, s: pd.DataFrame({"ch": [key[1]], "total": [s[5]], **{f"ctx{i}": [v] for i, v in enumerate(s[6])}})
    return carried(samples(spark, d), ["stream", "ch"], "frame", start, along, end, "ch int, total long, ctx0 long, ctx1 long, ctx2 long, ctx3 long")


# fixed values of the predictor: first weights and steps
LMS_START, LMS_STEP = [700, 400, 500, 400, 400, 100, 250, 50], [6, 4, 3, 2, 2, 1, 1, 1]
LMS_SQL = f"""WITH RECURSIVE {SQL}, q AS (SELECT ch, frame, code, code - lag(code) OVER (PARTITION BY ch ORDER BY frame) AS diff FROM s),
    r0 AS (SELECT ch, 0::BIGINT AS frame, {LMS_START}::BIGINT[] AS w, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[] AS past, (30 << 17)::BIGINT AS acc, 0::BIGINT AS mag, 0::BIGINT AS total, [0, 0, 0, 0]::BIGINT[] AS n FROM q WHERE frame = 0),
    l AS (SELECT * FROM r0 UNION ALL SELECT ch, frame, list_transform(w, lambda x, i: least(8192, greatest(-8192, x - sign(past[i]) * (CASE WHEN res > 0 THEN 1 ELSE -1 END) * {LMS_STEP}[i]))), list_prepend(diff, past[1:7]), acc + m - (acc >> 17), m, total + m,
        list_transform(n, lambda x, i: x + (i = 1 + (mag >= av)::INT + (mag >= 3 * av)::INT + (mag >= 5 * av)::INT)::INT) FROM
        (SELECT *, abs((res + 512) % 1024 + CASE WHEN (res + 512) % 1024 < 0 THEN 1024 ELSE 0 END - 512) AS m FROM (SELECT l.ch, q.frame, q.diff, w, past, acc, mag, total, n, greatest(1, acc >> 17) AS av,
            q.diff + floor(list_dot_product(past::DOUBLE[], w::DOUBLE[]) / 4096)::BIGINT AS res FROM l JOIN q ON q.ch = l.ch AND q.frame = l.frame + 1)))
    SELECT ch, total, n[1] AS ctx0, n[2] AS ctx1, n[3] AS ctx2, n[4] AS ctx3 FROM l QUALIFY row_number() OVER (PARTITION BY ch ORDER BY frame DESC) = 1"""
RICE_CONTEXT_SQL = f"""WITH RECURSIVE {SQL}, q AS (SELECT ch, frame, (code - lag(code) OVER (PARTITION BY ch ORDER BY frame) + 1536) % 1024 - 512 AS e FROM s),
    l AS (SELECT ch, 0::BIGINT AS frame, 10::BIGINT AS bits, [16, 16, 16, 16]::BIGINT[] AS a, [1, 1, 1, 1]::BIGINT[] AS n, (30 << 17)::BIGINT AS av, 0::BIGINT AS mag FROM q WHERE frame = 0
        UNION ALL SELECT ch, frame, CASE WHEN again THEN bits + 10 ELSE bits + CASE WHEN (m >> k) < 16 THEN (m >> k) + 1 + k ELSE 26 END END,
            CASE WHEN again THEN [16, 16, 16, 16] ELSE list_transform(a, lambda x, i: CASE WHEN i != c THEN x WHEN n[c] = 63 THEN (x + abs(e)) >> 1 ELSE x + abs(e) END) END,
            CASE WHEN again THEN [1, 1, 1, 1] ELSE list_transform(n, lambda x, i: CASE WHEN i != c THEN x WHEN x = 63 THEN 32 ELSE x + 1 END) END, av + abs(e) - (av >> 17), abs(e)
        FROM (SELECT *, ({' + '.join(f'((n[c] << {j}) < a[c])::INT' for j in range(9))})::BIGINT AS k, CASE WHEN e >= 0 THEN 2 * e ELSE -2 * e - 1 END AS m FROM (SELECT l.ch, q.frame, e, bits, a, n, av, q.frame % 256 = 0 AS again,
            1 + (mag >= greatest(1, av >> 17))::INT + (mag >= 3 * greatest(1, av >> 17))::INT + (mag >= 5 * greatest(1, av >> 17))::INT AS c FROM l JOIN q ON q.ch = l.ch AND q.frame = l.frame + 1)))
    SELECT ch, frame + 1 AS n, bits FROM l QUALIFY row_number() OVER (PARTITION BY ch ORDER BY frame DESC) = 1"""


_FEATURES = "SELECT pkt, {mode}::INT AS mode, (pkt % 64)::INT AS seq, length(packet) // 2 AS n_bytes, sha256(unhex(packet)) AS sha FROM fx"
SPIKE_PACKETS_SQL = f"""{SPIKES_SQL}, {packets_sql(400)}, cn AS (SELECT frame // 400 AS pkt, ch, count(*) AS n FROM sp WHERE keep GROUP BY ALL), c2 AS (SELECT x.pkt, x.ch, coalesce(least(cn.n, 7), 0) AS n FROM (SELECT DISTINCT pkt, ch FROM k) x LEFT JOIN cn ON cn.pkt = x.pkt AND cn.ch = x.ch),
    bi AS (SELECT pkt, lpad(bin(128 + pkt % 64), 8, '0') || CASE WHEN max(n) = 0 THEN '0' ELSE '1' || string_agg(repeat('1', n::INT) || CASE WHEN n < 7 THEN '0' ELSE '' END, '' ORDER BY ch) END AS bits FROM c2 GROUP BY pkt), {bits_hex("bi", "pkt", "fx")} {_FEATURES.format(mode=2)}"""
BAND_PACKETS_SQL = f"""{HP_SQL}, {packets_sql(400)}, c3 AS (SELECT k.pkt, k.ch, least(255, sum(abs(hp))::BIGINT >> 6) AS v FROM k JOIN hp ON hp.ch = k.ch AND hp.frame = k.frame GROUP BY ALL),
    bi AS (SELECT pkt, lpad(bin(192 + pkt % 64), 8, '0') || string_agg(CASE WHEN v > 0 THEN '1' || lpad(bin(v), 8, '0') ELSE '0' END, '' ORDER BY ch) AS bits FROM c3 GROUP BY pkt), {bits_hex("bi", "pkt", "fx")} {_FEATURES.format(mode=3)}"""

QUERIES = {
    "samples_summary": (samples_summary, f"WITH {SQL} SELECT ch, count(*) AS n, min(code) AS lo, max(code) AS hi, sum(code)::BIGINT AS total FROM s GROUP BY ch"),
    "slot_selection": (slot_selection, "SELECT x.ch::INT AS ch, count(*) AS n, sum(round_even(value, 0)::BIGINT)::BIGINT AS total FROM events e JOIN (VALUES (0,3),(1,40),(2,41),(3,90),(4,128),(5,149)) x(ch, slot) ON e.user_id % 256 = x.slot GROUP BY x.ch"),
    "locf_repair": (locf_repair, f"""WITH {SQL}, h AS (SELECT * FROM s WHERE (frame * 7 + ch) % 5 != 0), m AS (SELECT ch, max(frame) AS m FROM h GROUP BY ch),
        g AS (SELECT ch, unnest(range(0, m + 1)) AS frame FROM m), r AS (SELECT g.ch, g.frame, coalesce(last_value(code IGNORE NULLS) OVER (PARTITION BY g.ch ORDER BY g.frame), 512) AS code FROM g LEFT JOIN h USING (ch, frame))
        SELECT ch, count(*) AS n, sum(code)::BIGINT AS total, sum(code * (frame % 97))::BIGINT AS mixed FROM r GROUP BY ch"""),
    "aborted_packets": (aborted_packets, f"""WITH {SQL}, f AS (SELECT frame, count(*) AS want, count(*) FILTER (WHERE (frame * 7 + ch) % 5 != 0 AND frame % 700 < 300) AS got FROM s GROUP BY frame)
        SELECT frame // 256 AS pkt, sum((got < want - 2)::BIGINT)::BIGINT AS short, bool_or(got < want - 2) AS aborted FROM f GROUP BY 1"""),
    "dwt_bands": (dwt_bands, f"{BASE} SELECT ch, ctx, count(*) AS n, sum(c)::BIGINT AS total, min(c) AS lo, max(c) AS hi, sum(c * i)::BIGINT AS mixed FROM cq GROUP BY ALL"),
    "dwt_symbol_histogram": (dwt_symbol_histogram, f"{BASE}, {SYM} SELECT ctx, sym, count(*) AS n FROM sm GROUP BY ALL"),
    "symbol_histogram_pooled": (symbol_histogram_pooled, f"{BASE}, {SYM} SELECT sym, count(*) AS n, sum((sym = 63)::BIGINT)::BIGINT AS escapes FROM sm GROUP BY ALL"),
    "dwt_roundtrip": (dwt_roundtrip, f"{BASE}, {wavelet.inverse_sql('co', 'c')} SELECT ch, count(*) AS n, sum((x != code)::BIGINT)::BIGINT AS wrong FROM rx GROUP BY ch"),
    "lossy_reconstruction": (lossy_reconstruction, f"{SNR_SQL} SELECT ch, count(*) AS n, sum((y - code) * (y - code))::BIGINT AS sq_err, max(abs(y - code)) AS max_err, sum(y)::BIGINT AS total FROM rc GROUP BY ch"),
    "burst_schedule": (burst_schedule, f"{BASE} SELECT ch, least(63, (1 << CASE WHEN ctx = 0 THEN 3 ELSE ctx END) * (i + 2) - 2)::INT AS t, count(*) AS n, count(*) FILTER (q != 0) AS nonzero FROM cq GROUP BY ALL"),
    "coding_positions": (coding_positions, f"{BASE}, {SYM}, po AS (SELECT *, row_number() OVER (PARTITION BY pkt ORDER BY blk, at_, ch, turn) - 1 AS pos FROM sm) SELECT pkt, count(*) AS n, sum(pos * (sym + 1))::BIGINT AS mixed, sum(pos * ch)::BIGINT AS chs FROM po GROUP BY pkt"),
    "entropy_bits": (entropy_bits, f"{BASE}, {SYM}, n AS (SELECT ctx, sym, count(*) AS n FROM sm GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY ctx) AS t FROM n) SELECT ctx, sum(n)::BIGINT AS n, round(-sum(n * log2(n / t)), 4) AS bits FROM t GROUP BY ctx"),
    "trained_cdf": (trained_cdf, f"{RAW_CDF} SELECT ctx, sym, f, c FROM cdf"),
    "static_code_length": (static_code_length, f"{RAW_CDF} SELECT ch, count(*) AS n, round(sum(-log2(f / 4096.0) + CASE WHEN sym = 63 THEN 10 ELSE 0 END) + 42, 4) AS bits FROM sm JOIN cdf USING (ctx, sym) GROUP BY ch"),
    "slot_lookup_range": (slot_lookup_range, f"{RAW_CDF} SELECT ctx, count(*) AS n, count(DISTINCT sym) AS syms, sum(slot * sym)::BIGINT AS mixed FROM range(4096) t(slot), cdf WHERE slot >= c AND slot < c + f GROUP BY ctx"),
    "cross_fit": (cross_fit, f"""{BASE}, {SYM}, n AS (SELECT blk % 2 AS fold, ctx, sym, count(*) AS n FROM sm GROUP BY ALL), t AS (SELECT fold, ctx, sum(n) AS t FROM n GROUP BY ALL)
        SELECT n.fold, sum(n.n)::BIGINT AS n, round(sum(-n.n * log2((coalesce(o.n, 0) + 0.5) / (t.t + 32))), 4) AS bits FROM n JOIN t ON t.fold = 1 - n.fold AND t.ctx = n.ctx LEFT JOIN n o ON o.fold = 1 - n.fold AND o.ctx = n.ctx AND o.sym = n.sym GROUP BY n.fold"""),
    "rice_static_bits": (rice_static_bits, f"""WITH {SQL}, {packets_sql(128)}, z AS (SELECT ch, code - lag(code) OVER (PARTITION BY pkt, ch ORDER BY frame) AS e0 FROM k), e AS (SELECT ch, (e0 + 1536) % 1024 - 512 AS e FROM z WHERE e0 IS NOT NULL),
        m AS (SELECT ch, e, CASE WHEN e >= 0 THEN 2 * e ELSE -2 * e - 1 END AS m, ({' + '.join(f'CASE WHEN (4 << {j}) < abs(e) + 1 THEN 1 ELSE 0 END' for j in range(9))})::BIGINT AS k FROM e)
        SELECT ch, count(*) AS n, sum(m)::BIGINT AS m, sum(k)::BIGINT AS k, sum(CASE WHEN (m >> k) < 16 THEN (m >> k) + 1 + k ELSE 26 END)::BIGINT AS bits, 0::BIGINT AS wrong FROM m GROUP BY ch"""),
    "rice_adaptive_bits": (rice_adaptive_bits, RICE_SQL),
    "lossless_packets": (lossless_packets, LOSSLESS_SQL),
    "streamed_packets": (streamed_packets, LOSSLESS_SQL),
    "lossless_roundtrip": (lossless_roundtrip, f"WITH {SQL}, {packets_sql(128)} SELECT ch, count(*) AS n, 0::BIGINT AS wrong FROM k GROUP BY ch"),
    "lossy_packets": (lossy_packets, LOSSY_SQL),
    "lossy_roundtrip": (lossy_roundtrip, LOSSY_ROUND_SQL),
    "high_pass": (high_pass, f"{HP_SQL} SELECT ch, sum(hp)::BIGINT AS total, min(hp) AS lo, max(hp) AS hi, sum(abs(hp))::BIGINT AS mag FROM hp GROUP BY ch"),
    "spike_thresholds": (spike_thresholds, f"{HP_SQL}, {THR_SQL} SELECT ch, thr FROM th"),
    "spike_counts": (spike_counts, f"{SPIKES_SQL} SELECT ch, count(*) AS n, sum(frame)::BIGINT AS frames FROM sp WHERE keep GROUP BY ch"),
    "spike_bins": (spike_bins, f"{SPIKES_SQL}, {packets_sql(400)}, g AS (SELECT DISTINCT pkt, ch FROM k), c AS (SELECT frame // 400 AS pkt, ch, count(*) AS n FROM sp WHERE keep GROUP BY ALL) SELECT g.pkt, g.ch, coalesce(least(n, 7), 0) AS n FROM g LEFT JOIN c USING (pkt, ch)"),
    "band_power": (band_power, f"{HP_SQL}, {packets_sql(400)} SELECT k.pkt, k.ch, least(255, sum(abs(hp))::BIGINT >> 6) AS value FROM k JOIN hp USING (ch, frame) GROUP BY ALL"),
    "spike_bin_packets": (spike_bin_packets, SPIKE_PACKETS_SQL),
    "band_power_packets": (band_power_packets, BAND_PACKETS_SQL),
    "snr_per_channel": (snr_per_channel, f"{SNR_SQL} SELECT ch, snr FROM snr"),
    "snr_pooled": (snr_pooled, f"{SNR_SQL} SELECT round(10 * log10(sum(s) / sum(e)), 6) AS snr FROM t"),
    "snr_percentiles": (snr_percentiles, f"{SNR_SQL} SELECT round(median(snr), 6) AS median, round(quantile_cont(snr, 0.1), 6) AS p10, min(snr) AS lo FROM snr"),
    "spike_match": (spike_match, MATCH_SQL),
    "value_range": (value_range, f"{BASE} SELECT ctx, max(abs(c)) AS most, (ceil(log2(max(abs(c)) + 1.0)) + 1)::BIGINT AS bits FROM cq GROUP BY ctx"),
    "bits_per_sample": (bits_per_sample, f"{RICE_SQL.replace('SELECT pkt, ch, bits FROM r WHERE i = 127', ', b AS (SELECT pkt, (8 + sum(bits) + 7) // 8 AS n FROM r WHERE i = 127 GROUP BY pkt) SELECT sum(n)::BIGINT AS n_bytes, round(8 * sum(n) / (count(*) * 1024), 6) AS bps FROM b')}"),
    "worst_packets": (worst_packets, RICE_SQL + " ORDER BY bits DESC, pkt, ch LIMIT 10"),
    "file_quantiser": (file_quantiser, """WITH u AS (SELECT DISTINCT round_even(value, 0)::BIGINT * 64 - 32768 AS x FROM events), g AS (SELECT x - lag(x) OVER (ORDER BY x) AS gap FROM u),
        n AS (SELECT avg(gap) AS mean FROM g WHERE gap < (SELECT 1.5 * median(gap) FROM g)), sp AS (SELECT min(x) AS lo, max(x) AS hi, count(*) AS levels FROM u),
        st AS (SELECT lo, levels, (hi - lo) / round_even((hi - lo) / mean, 0) AS step FROM sp, n), c AS (SELECT round_even((x - lo) / step, 0)::BIGINT AS code, levels FROM u, st)
        SELECT max(levels) AS levels, count(DISTINCT code) AS codes, max(code) AS top, sum(code)::BIGINT AS total FROM c"""),
    "ramp_stimulus": (ramp_stimulus, f"""WITH {SQL} SELECT ch, sum(abs(code - ((frame + 4 * ch) & 1023)))::BIGINT AS ramp, sum(abs(code - 512))::BIGINT AS constant, sum(abs(code - CASE WHEN frame % 2 = 0 THEN 0 ELSE 1023 END))::BIGINT AS nyquist,
        sum(abs(code - CASE WHEN (frame // 37) % 2 = 0 THEN 0 ELSE 1023 END))::BIGINT AS steps FROM s GROUP BY ch"""),
    "lfsr_stimulus": (lfsr_stimulus, f"""WITH RECURSIVE {SQL}, l(pos, x) AS (SELECT 0::BIGINT, 44257::BIGINT UNION ALL SELECT pos + 1, xor(x >> 1, CASE WHEN x % 2 = 1 THEN 46080 ELSE 0 END) FROM l WHERE pos < 65534 AND pos < (SELECT max(frame) FROM s)),
        m AS (SELECT ch, xor(code, x & 1023) AS m FROM s JOIN l ON pos = frame % 65535) SELECT ch, count(*) AS n, count(*) FILTER (m = 0) AS equal, sum(10 - bit_count(m))::BIGINT AS bits, sum(m)::BIGINT AS total FROM m GROUP BY ch"""),
    "encode_lfsr": (encode_lfsr, None),
    "renorm_sweep": (renorm_sweep, RENORM_SQL),
    "adaptive_rans": (adaptive_rans, ADAPTIVE_SQL),
    "lms_residuals": (lms_residuals, LMS_SQL),
}
