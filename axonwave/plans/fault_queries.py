"""Queries of fault search by meeting traces, tolerant decoding with snapshots, and what is explained where nothing fits.

The faults are put into packets of the event table first, each by a rule over its packet number, and then looked for in the damaged bytes alone.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from axonwave.functions import tracing
from axonwave.functions.tracing import Coder
from axonwave.operators import codecs, faults, wavelet
from axonwave.plans.packet_sql import LOSSY_CODED
from axonwave.plans.samples import blocks, samples
from axonwave.plans.signal_queries import N

KEYS, CODER, EVERY = ["stream", "pkt"], Coder(N), 256


def coded(spark, d):
    """(expected symbols with f, c, raw; payloads as coded, without headers; tables)."""
    sym = codecs.whole_packets(wavelet.symbols(blocks(samples(spark, d))), N)
    tables = codecs.trained_tables(sym)
    packets = codecs.encode_lossy(sym, tables, N)
    return faults.coded_symbols(sym, tables), packets.select(*KEYS, F.expr("substring(bytes, 2)").alias("payload")), tables


def _flipped(payload, *places):
    """payload with bit 4 of the byte at each place (from 0) inverted."""
    digits = F.hex(payload)
    for at in places:
        k = (2 * at + 1).cast("int")
        digits = F.concat(F.substring(digits, F.lit(1), k - 1), F.translate(F.substring(digits, k, F.lit(1)), "0123456789ABCDEF", "1032547698BADCFE"), F.substring(digits, k + 1, F.length(digits)))
    return F.unhex(digits)


def _body():
    return F.length("payload") - CODER.n_ch * CODER.state_bytes


def tolerant_decode(spark, d):
    """A damaged byte in every packet: segments between snapshots that are clean, and wrong symbols in those."""
    x, p, tables = coded(spark, d)
    bad = p.select(*KEYS, _flipped(F.col("payload"), (F.col("pkt") * 97 + 5) % _body()).alias("payload"))
    order = [(c, k) for _, c, k, _ in codecs.coding_order(N)]
    got = faults.decode_tolerant(bad, KEYS, order, tables, CODER, faults.snapshots(x, KEYS, CODER, EVERY))
    each = got.select(*KEYS, "k", "clean", F.posexplode("syms").alias("i", "got")).withColumn("pos", F.col("k") + F.col("i"))
    j = each.join(x.select(*KEYS, "pos", "sym"), [*KEYS, "pos"])
    return j.groupBy("pkt", "k").agg(F.first("clean").alias("clean"), F.count_if(F.col("clean") & (F.col("got") != F.col("sym"))).alias("wrong"))


def fault_bounds(spark, d):
    """Two damaged bytes: no single upset explains the packet, and how many symbols its start still does."""
    x, p, _ = coded(spark, d)
    bad = p.select(*KEYS, _flipped(F.col("payload"), F.floor(_body() / 4) + F.col("pkt") % 7, F.floor(_body() / 2) + F.col("pkt") % 11).alias("payload"))
    rows = faults.traced(x, bad, KEYS, CODER)
    fits = faults.upsets(rows, KEYS, CODER).groupBy(*KEYS).agg(F.count("*").alias("fits"))
    return rows.join(fits, KEYS, "left").select("pkt", "n", "prefix", "clean", F.coalesce("fits", F.lit(0)).alias("fits"))


def upset(pkt: int, n: int):
    """The fault of a packet: (symbol, kind, bit)."""
    kind, bits = faults.UPSETS[pkt % len(faults.UPSETS)]
    return (pkt * 389 + 700) % n, kind, (pkt * 7 + 3) % bits


def coder_upsets(spark, d):
    """An upset in every packet, of a state, a table entry or a write-back: whether it is among the single upsets that explain the bytes, and how many do."""
    x, _, _ = coded(spark, d)

    def damage(pdf):
        s, k = faults.coded_of(pdf), int(pdf.pkt.iloc[0])
        j, kind, bit = upset(k, len(pdf))
        flip = lambda v, of: v ^ (1 << bit if kind == of else 0)
        alter = lambda i, y, f, c: (flip(y, "state"), flip(f, "frequency"), flip(c, "start"), lambda z: flip(z, "write_back")) if i == j else (y, f, c, None)
        bounds, out = tracing.forward(s, CODER, None, alter)
        end = bounds.get(len(pdf))
        return pd.DataFrame({"stream": pdf.stream.iloc[0], "pkt": [k], "symbol": [j], "fault": [kind], "flipped": [bit], "payload": [out + CODER.tail(end[1]) if end else None]})

    schema = "stream long, pkt long, symbol int, fault string, flipped int, payload binary"
    bad = x.select(*KEYS, "pos", "ch", "f", "c", "raw").groupBy(*KEYS).applyInPandas(damage, schema).where("payload IS NOT NULL")
    rows = faults.traced(x, bad, KEYS, CODER)
    fits = faults.upsets(rows, KEYS, CODER).join(bad.drop("payload"), KEYS)
    hit = (F.col("k") == F.col("symbol")) & (F.col("kind") == F.col("fault")) & (F.col("bit") == F.col("flipped"))
    found = fits.groupBy(*KEYS).agg(F.max(hit).alias("found"), F.count("*").alias("candidates"))
    return rows.join(bad.drop("payload"), KEYS).join(found, KEYS, "left").select("pkt", "symbol", F.col("fault").alias("kind"), "flipped", "clean", F.coalesce("found", F.lit(False)).alias("found"), F.coalesce("candidates", F.lit(0)).alias("candidates"))


_AT = "at_ AS (SELECT pkt, pos, sum(n) OVER (PARTITION BY pkt ORDER BY pos) - n AS lo, n, raw, sum(n) OVER (PARTITION BY pkt) AS body FROM (SELECT x.pkt, x.pos, length(x.put) // 2 AS n, length(y.raw) // 2 AS raw FROM rput x JOIN ly y ON x.pkt = y.pkt AND x.pos = y.pos))"
TOLERANT_SQL = f"""{LOSSY_CODED}, {_AT}, h AS (SELECT pkt, pos // {EVERY} AS s, body, (pkt * 97 + 5) % body AS a, lo, n, raw FROM at_)
    SELECT pkt, (s * {EVERY})::INT AS k, NOT bool_or(a >= lo + raw AND a < lo + n) AS clean, 0::BIGINT AS wrong FROM h GROUP BY pkt, s"""
BOUNDS_SQL = f"""{LOSSY_CODED}, {_AT}, h AS (SELECT *, body // 4 + pkt % 7 AS a, count(*) OVER (PARTITION BY pkt) AS of FROM at_)
    SELECT pkt, of::INT AS n, min(pos) FILTER (a >= lo AND a < lo + n)::INT AS prefix, false AS clean, 0::BIGINT AS fits FROM h GROUP BY pkt, of"""

QUERIES = {
    "tolerant_decode": (tolerant_decode, TOLERANT_SQL),
    "fault_bounds": (fault_bounds, BOUNDS_SQL),
    "coder_upsets": (coder_upsets, None),
}
