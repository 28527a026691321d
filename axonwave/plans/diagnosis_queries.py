"""Queries of single-fault diagnosis, coder variants, rate tables and stream bounds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from axonwave.functions import coding, tracing
from axonwave.operators import codecs, faults, rates, wavelet
from axonwave.operators.folds import carried
from axonwave.operators.graphs import reach
from axonwave.plans.packet_sql import LOSSY_CODED, rice_hex
from axonwave.plans.protocol_queries import EDGES, edges
from axonwave.plans.samples import BLOCKS_SQL, SQL, blocks, packets, packets_sql, samples, table
from axonwave.plans.signal_queries import N, RICE_SQL, SPIKES_SQL, rice_adaptive_bits, RICE_CONTEXT_SQL

BASE = f"WITH {SQL}, {BLOCKS_SQL}, {wavelet.forward_sql()}"


def header_codec(spark, d):
    """Header bytes of the event table's packets (user and event number as mode and count), taken apart again."""
    x = table(spark, d, "events").select(F.col("user_id").bitwiseAND(F.lit(3).cast("long")).alias("mode"), F.col("event_id").bitwiseAND(F.lit(63).cast("long")).alias("seq"))
    x = x.withColumn("head", F.shiftleft("mode", 6).bitwiseOR(F.col("seq")))
    return x.groupBy("mode", "seq", "head", F.shiftright("head", 6).alias("mode_back"), F.col("head").bitwiseAND(F.lit(63).cast("long")).alias("seq_back")).agg(F.count("*").alias("n"))


def restoring_division(spark, d):
    """Quotient and remainder bit by bit, as a divider without a multiplier does it."""
    x = samples(spark, d).select("frame", (F.col("code") * 1021 + 7).alias("x"), (F.pmod(F.col("code") * 31, F.lit(4000)) + 1).alias("f"))
    q, r = F.lit(0).cast("long"), F.lit(0).cast("long")
    x = x.withColumns({"q": q, "r": r})
    for bit in range(21, -1, -1):
        r = F.shiftleft("r", 1) + F.shiftright("x", bit).bitwiseAND(F.lit(1).cast("long"))
        x = x.withColumn("r", r)
        x = x.withColumns({"q": F.shiftleft("q", 1) + (F.col("r") >= F.col("f")).cast("long"), "r": F.when(F.col("r") >= F.col("f"), F.col("r") - F.col("f")).otherwise(F.col("r"))})
    return x.agg(F.sum("q").alias("q"), F.sum("r").alias("r"), F.sum((F.col("q") * F.col("f") + F.col("r") != F.col("x")).cast("long")).alias("wrong"))


def group_rates(spark, d):
    """Bits a sample of each packet, worst first, with rank and share of all bits."""
    p = rice_adaptive_bits(spark, d).groupBy("pkt").agg(F.sum("bits").alias("bits"))
    sizes = p.groupBy("bits").agg(F.count("*").alias("n"))  # as many rows as there are sizes of a packet
    above = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("bits")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = F.broadcast(sizes.select("bits", (above + 1).alias("rank")))
    total = F.broadcast(p.agg(F.sum("bits").alias("total")))
    return p.join(ranks, "bits").crossJoin(total).select("pkt", "bits", F.round(F.col("bits") / (128 * N), 6).alias("bps"), "rank", F.round(F.col("bits") / F.col("total"), 8).alias("share"))


def frame_alignment(spark, d):
    """Shift of a received signal against the expected one: the shift with most equal codes."""
    s = samples(spark, d)
    got = s.select("ch", (F.col("frame") - 3).alias("frame"), F.col("code").alias("got")).where("frame >= 0")
    shifts = F.broadcast(spark.range(8).select(F.col("id").alias("shift")))
    j = got.join(shifts).withColumn("at", F.col("frame") + F.col("shift")).join(s.select("ch", F.col("frame").alias("at"), "code"), ["ch", "at"])
    score = j.groupBy("shift").agg(F.round(F.avg((F.col("got") == F.col("code")).cast("double")), 9).alias("score"))
    return score.agg(F.max_by("shift", F.struct("score", -F.col("shift"))).alias("shift"), F.max("score").alias("score"))


def byte_edits(spark, d):
    """One byte corrupt, dropped or doubled in a packet, found by comparing with the expected bytes."""
    p = codecs.encode_lossless(samples(spark, d)).select("pkt", "bytes")

    def classify(a: bytes, b: bytes) -> tuple[str, int]:
        i = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
        if a == b:
            return "same", -1
        if len(a) == len(b):
            return ("corrupt", i) if a[i + 1 :] == b[i + 1 :] else ("other", i)
        if len(b) == len(a) - 1 and a[i + 1 :] == b[i:]:
            return "dropped", i
        return ("inserted", i) if len(b) == len(a) + 1 and a[i:] == b[i + 1 :] else ("other", i)

    def many(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                a, k = bytes(r.bytes), int(r.pkt) * 37 % 900 + 40
                b = [a, a[:k] + bytes([a[k] ^ 1]) + a[k + 1 :], a[:k] + a[k + 1 :], a[:k] + b"\xa5" + a[k:]][int(r.pkt) % 4]
                out.append((r.pkt, *classify(a, b), len(a) > k and k))
            yield pd.DataFrame(out, columns=["pkt", "kind", "at", "true_at"])

    return p.mapInPandas(many, "pkt long, kind string, at long, true_at long").select("pkt", "kind", (F.abs(F.col("at") - F.col("true_at")) <= 1).alias("near"))


def state_flips(spark, d):
    """Which flipped bit of a coder state, after which symbol, explains a channel's bytes in a packet: states from the start and states undone from the end meet there."""
    keys, coder = ["stream", "pkt", "ch"], tracing.Coder(1, state_bytes=4)
    sym = codecs.whole_packets(wavelet.symbols(blocks(samples(spark, d))), N)
    x = faults.coded_symbols(sym, codecs.trained_tables(sym)).select(*keys, "pos", F.lit(0).alias("own"), "f", "c", F.lit(None).cast("binary").alias("raw"))

    def damage(pdf):
        c = int(pdf.ch.iloc[0])
        s = faults.coded_of(pdf.drop(columns="ch").rename(columns={"own": "ch"}))
        flip = lambda k, y, f, b: (y, f, b, (lambda z: z ^ 1 << 3 + c % 5) if k == 11 + c else None)
        bounds, out = tracing.forward(s, coder, None, flip)
        return pd.DataFrame({k: [pdf[k].iloc[0]] for k in keys} | {"payload": [out + coder.tail(bounds[len(pdf)][1])]})

    bad = x.groupBy(*keys).applyInPandas(damage, "stream long, pkt long, ch int, payload binary")
    by = ["stream", "pkt", "of"]
    rows = faults.traced(x.withColumnRenamed("ch", "of").withColumnRenamed("own", "ch"), bad.withColumnRenamed("ch", "of"), by, coder)
    fits = faults.upsets(rows, by, coder, kinds=(("write_back", 14),))
    true = (F.col("k") == 11 + F.col("of")) & (F.col("bit") == 3 + F.col("of") % 5)
    found = fits.groupBy(*by).agg(F.max(true).alias("found"), F.count("*").alias("candidates"))
    return rows.join(found, by, "left").select("stream", "pkt", F.col("of").alias("ch"), F.coalesce("found", F.lit(False)).alias("found"), F.coalesce("candidates", F.lit(0)).alias("candidates"), "clean")


def single_state_rans(spark, d):
    """Byte-wise coder with one 32-bit state for each packet: coded forward, undone from the end."""
    sym = codecs.whole_packets(wavelet.symbols(blocks(samples(spark, d))), N)
    tables = codecs.trained_tables(sym)
    low = 1 << 23

    def one(pdf):
        pdf = pdf.sort_values("pos")
        s, k = pdf.sym.tolist(), pdf.ctx.tolist()
        x, out = low, bytearray()
        for a, c in zip(s, k, strict=True):
            x, units = coding.rans_step(x, tables[c][a + 1] - tables[c][a], tables[c][a], 4096, 11)
            out += bytes(units)
        order, data = [(0, c) for c in k], bytes(out) + x.to_bytes(4, "little")
        back = coding.rans_unpacked(data, order, tables, 1, None, lsh=11, state_bytes=4)
        return pd.DataFrame({"pkt": [int(pdf.pkt.iloc[0])], "n_bytes": [len(data)], "wrong": [sum(a != b for a, (b, _) in zip(s, back, strict=True))]})

    return sym.groupBy("pkt").applyInPandas(one, "pkt long, n_bytes long, wrong long")


def rice_context_bits(spark, d, reset: int = 256):
    """Adaptive Rice cost with one tracker for each of four contexts of the last magnitude, reset at fixed frames.

    Only the average magnitude outlives a reset. One cheap pass along a channel finds it at every reset; the trackers, which cost most, then run for all
    stretches between resets at once.
    """

    def averages(state, rows):
        last, avg, mag, out = *state, []
        for t, x in zip(rows.frame.tolist(), rows.code.tolist(), strict=True):
            if t % reset == 0:
                out.append((t // reset, last, avg, mag))
            if last is not None:
                mag = abs((x - last + 512) % 1024 - 512)
                avg += mag - (avg >> 17)
            last = x
        at = {c: rows[c].iloc[0] for c in ("stream", "ch")}
        return (last, avg, mag), pd.DataFrame(out, columns=["run", "last", "avg", "mag"]).assign(**at)[["stream", "ch", "run", "last", "avg", "mag"]] if out else None

    def stretch(pdf):
        pdf = pdf.sort_values("frame")
        last, avg, mag = pdf["last"].iloc[0], int(pdf.avg.iloc[0]), int(pdf.mag.iloc[0])
        last, bits, state = None if pd.isna(last) else int(last), 0, [[16, 1] for _ in range(4)]
        for t, x in zip(pdf.frame.tolist(), pdf.code.tolist(), strict=True):
            e = 0 if last is None else (x - last + 512) % 1024 - 512
            if t % reset == 0:
                bits += 10
            else:
                m = max(1, avg >> 17)
                c = (mag >= m) + (mag >= 3 * m) + (mag >= 5 * m)
                a, n = state[c]
                k = next((k for k in range(9) if n << k >= a), 9)
                q = (2 * e if e >= 0 else -2 * e - 1) >> k
                bits += q + 1 + k if q < 16 else 26
                a, n = a + abs(e), n + 1
                state[c] = [a >> 1, n >> 1] if n == 64 else [a, n]
            if last is not None:
                mag = abs(e)
                avg += mag - (avg >> 17)
            last = x
        return pd.DataFrame({"stream": [pdf.stream.iloc[0]], "ch": [pdf.ch.iloc[0]], "n": [len(pdf)], "bits": [bits]})

    x = samples(spark, d)
    runs = carried(x, ["stream", "ch"], "frame", lambda: (None, 30 << 17, 0), averages, lambda key, state: None, "stream long, ch int, run long, last long, avg long, mag long")
    rows = x.withColumn("run", F.floor(F.col("frame") / reset)).join(runs, ["stream", "ch", "run"])
    each = rows.groupBy("stream", "ch", "run").applyInPandas(stretch, "stream long, ch int, n long, bits long")
    return each.groupBy("stream", "ch").agg(F.sum("n").alias("n"), F.sum("bits").alias("bits")).drop("stream")


def mode_table(spark, d):
    """Packets, bytes and bits a sample of the four modes."""
    x = samples(spark, d)
    hp = codecs.high_passed(x)
    spk = codecs.spikes(hp, codecs.thresholds(hp, 1.0))
    modes = [(codecs.encode_lossless(x), 128), (codecs.lossy_packets(x, N)[0], 256), (codecs.feature_packets(codecs.binned(x, spk), "n", 2), 400), (codecs.feature_packets(codecs.band_power(hp), "value", 3), 400)]
    out = None
    for p, frames in modes:
        one = p.select("mode", F.length("bytes").alias("b"), F.lit(frames * N).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("mode").agg(F.count("*").alias("packets"), F.sum("b").alias("n_bytes"), F.round(8 * F.sum("b") / F.sum("n"), 6).alias("bps"), F.round(10 * F.sum("n") / (8 * F.sum("b")), 6).alias("ratio"))


def mode_rates(spark, d):
    """The benchmark table: modes calibrated on the first 256 frames and measured on the rest."""
    r = rates.mode_rates(samples(spark, d), N, 256, 19531.0, 1.0)
    return r.select("mode", "packets", "n_bytes", "samples", *[F.round(c, 6).alias(c) for c in ("bps", "vs_10", "vs_16", "vs_feature", "note")])


def dependency_horizon(spark, d):
    """The last frame of a block whose symbols depend on a sample: one sample of every recorded block is changed, and the coefficients of both are compared."""
    b = blocks(samples(spark, d))
    place = F.pmod(F.col("blk") * 7 + F.col("ch"), F.lit(64))
    other = b.withColumn("code", F.when(F.col("p") == place, F.when(F.col("code") < 512, F.col("code") + 400).otherwise(F.col("code") - 400)).otherwise(F.col("code")))
    ctx, i = wavelet.band(3)
    level = F.when(F.col("ctx") == 0, 3).otherwise(F.col("ctx"))
    when = F.least(F.lit(63), F.pow(F.lit(2), level).cast("long") * (F.col("i") + 2) - 2)
    c = [wavelet.forward(v).select("stream", "ch", "blk", "p", F.col("c").alias(k)) for v, k in ((b, "c"), (other, "c2"))]
    j = c[0].join(c[1], ["stream", "ch", "blk", "p"]).where("c != c2").withColumns({"ctx": ctx, "i": i})
    return j.groupBy(place.cast("int").alias("frame")).agg(F.max(when).alias("horizon"), F.count("*").alias("changed"))


def output_queue(spark, d):
    """Depth of an output queue that takes each frame's bytes and drains a fixed number: the running maximum of backlog."""
    b = samples(spark, d).groupBy("frame").agg(F.sum(F.floor(F.col("code") / 128)).alias("bytes"))
    # sums and minima within ranges of frames, then over the ranges, so that no task sorts all frames
    b = b.withColumn("range", F.floor(F.col("frame") / 65536))
    w = Window.partitionBy("range").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    t = b.withColumn("net", F.sum(F.col("bytes") - 26).over(w))
    t = t.withColumn("low", F.min("net").over(w))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # rows: ranges
    r = t.groupBy("range").agg(F.sum(F.col("bytes") - 26).alias("all"), F.min("low").alias("least"))
    r = r.withColumn("from", F.coalesce(F.sum("all").over(before), F.lit(0)))
    r = r.withColumn("least", F.least(F.lit(0), F.coalesce(F.min(F.col("from") + F.col("least")).over(before), F.lit(0)))).select("range", "from", "least")
    t = t.join(F.broadcast(r), "range")
    t = t.withColumn("depth", F.col("from") + F.col("net") - F.least("least", F.col("from") + F.col("low")))
    return t.agg(F.max("depth").alias("deepest"), F.sum((F.col("depth") > 0).cast("long")).alias("busy"), F.count("*").alias("frames"))


def clock_network(spark, d):
    """Cells reached from the roots through buffers only, by depth."""
    e = edges(spark, d).where("src NOT LIKE 's%'")
    roots = table(spark, d, "region").where("r_regionkey < 2").select(F.concat(F.lit("r"), "r_regionkey").alias("node"))
    return reach(roots, e).groupBy("root", "depth").agg(F.count("*").alias("cells"))


def block_attribution(spark, d):
    """Block of each cell by the majority of its neighbours' labels."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = c.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    best = n.withColumn("r", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("n"), "c_mktsegment"))).where("r = 1")
    return c.join(F.broadcast(best.select("c_nationkey", F.col("c_mktsegment").alias("block"))), "c_nationkey").groupBy("block").agg(F.count("*").alias("cells"), F.sum((F.col("block") == F.col("c_mktsegment")).cast("long")).alias("agree"))


def fault_table(spark, d):
    """Faults by class: found, missed, and share found."""
    e = table(spark, d, "events").select(F.col("event_type").alias("class"), (F.col("value") > 50).alias("found"))
    return e.groupBy("class").agg(F.count("*").alias("faults"), F.sum(F.col("found").cast("long")).alias("found"), F.round(F.avg(F.col("found").cast("double")), 9).alias("share"))


def retrained_generalisation(spark, d):
    """Entropy of the first half of the blocks, and cost of the second half under the first half's counts."""
    s = wavelet.symbols(blocks(samples(spark, d)))
    half = s.groupBy("stream", "ch").agg(((F.max("blk") + 1) / 2).alias("half"))
    s = s.join(half, ["stream", "ch"]).withColumn("train", F.col("blk") < F.col("half"))
    n = s.groupBy("train", "ctx", "sym").agg(F.count("*").alias("n"))
    t, h = n.where("train"), n.where("NOT train")
    total = t.groupBy("ctx").agg(F.sum("n").alias("t"))
    j = h.join(total, "ctx").join(t.select("ctx", "sym", F.col("n").alias("m")), ["ctx", "sym"], "left")
    return j.groupBy("ctx").agg(F.sum("n").alias("n"), F.round(F.sum(-F.col("n") * F.log2((F.coalesce("m", F.lit(0)) + 0.5) / (F.col("t") + 32))) / F.sum("n"), 6).alias("bits_per_symbol"))


_PACKETS = {f: packets_sql(f).replace("k AS (", f"k{f} AS (", 1) for f in (128, 400)}
MODES_SQL = f"""{LOSSY_CODED}, {_PACKETS[128]}, {_PACKETS[400]}, q AS (SELECT pkt, ch, frame % 128 AS i, code FROM k128), {rice_hex("q", "")}, {SPIKES_SQL.split(f"{SQL}, ", 1)[1]},
    cn AS (SELECT frame // 400 AS pkt, ch, count(*) AS n FROM sp WHERE keep GROUP BY ALL), c2 AS (SELECT x.pkt, x.ch, coalesce(least(cn.n, 7), 0) AS n FROM (SELECT DISTINCT pkt, ch FROM k400) x LEFT JOIN cn ON cn.pkt = x.pkt AND cn.ch = x.ch),
    c3 AS (SELECT k400.pkt, k400.ch, least(255, sum(abs(hp))::BIGINT >> 6) AS v FROM k400 JOIN hp ON hp.ch = k400.ch AND hp.frame = k400.frame GROUP BY ALL),
    pk AS (SELECT 0 AS mode, length(packet) // 2 AS b, 128 * 8 AS n FROM rice_hex UNION ALL SELECT 1, length(packet) // 2 + 1, 256 * 8 FROM rans_hex
        UNION ALL SELECT 2, (9 + CASE WHEN max(n) > 0 THEN sum(CASE WHEN n = 7 THEN 7 ELSE n + 1 END) ELSE 0 END + 7)::BIGINT // 8, 400 * 8 FROM c2 GROUP BY pkt
        UNION ALL SELECT 3, (8 + sum(CASE WHEN v > 0 THEN 9 ELSE 1 END) + 7)::BIGINT // 8, 400 * 8 FROM c3 GROUP BY pkt)
    SELECT mode::INT AS mode, count(*) AS packets, sum(b)::BIGINT AS n_bytes, round(8 * sum(b) / sum(n), 6) AS bps, round(10 * sum(n) / (8 * sum(b)), 6) AS ratio FROM pk GROUP BY mode"""

QUERIES = {
    "header_codec": (header_codec, "SELECT user_id & 3 AS mode, event_id & 63 AS seq, ((user_id & 3) << 6) | (event_id & 63) AS head, user_id & 3 AS mode_back, event_id & 63 AS seq_back, count(*) AS n FROM events GROUP BY ALL"),
    "restoring_division": (restoring_division, f"WITH {SQL}, x AS (SELECT code * 1021 + 7 AS x, (code * 31) % 4000 + 1 AS f FROM s) SELECT sum(x // f)::BIGINT AS q, sum(x % f)::BIGINT AS r, 0::BIGINT AS wrong FROM x"),
    "group_rates": (group_rates, RICE_SQL.replace("SELECT pkt, ch, bits FROM r WHERE i = 127", ", p AS (SELECT pkt, sum(bits)::BIGINT AS bits FROM r WHERE i = 127 GROUP BY pkt) SELECT pkt, bits, round(bits / 1024, 6) AS bps, rank() OVER (ORDER BY bits DESC) AS rank, round(bits / sum(bits) OVER (), 8) AS share FROM p")),
    "frame_alignment": (frame_alignment, f"""WITH {SQL}, g AS (SELECT ch, frame - 3 AS frame, code AS got FROM s WHERE frame >= 3), j AS (SELECT sh, (got = s.code)::INT::DOUBLE AS e FROM g, range(8) t(sh), s WHERE s.ch = g.ch AND s.frame = g.frame + sh),
        a AS (SELECT sh, round(avg(e), 9) AS score FROM j GROUP BY sh) SELECT arg_max(sh, (score, -sh)) AS shift, max(score) AS score FROM a"""),
    "byte_edits": (byte_edits, None),
    "state_flips": (state_flips, None),
    "single_state_rans": (single_state_rans, None),
    "rice_context_bits": (rice_context_bits, RICE_CONTEXT_SQL),
    "mode_table": (mode_table, MODES_SQL),
    "mode_rates": (mode_rates, None),
    "dependency_horizon": (dependency_horizon, f"""WITH {SQL}, {BLOCKS_SQL.replace("b AS (", "b1 AS (", 1)}, b AS (SELECT * FROM b1 UNION ALL SELECT stream + 1, ch, blk, p, CASE WHEN p != (blk * 7 + ch) % 64 THEN code WHEN code < 512 THEN code + 400 ELSE code - 400 END FROM b1), {wavelet.forward_sql()}
        SELECT ((x.blk * 7 + x.ch) % 64)::INT AS frame, max(least(63, (1 << CASE WHEN x.ctx = 0 THEN 3 ELSE x.ctx END) * (x.i + 2) - 2))::BIGINT AS horizon, count(*) AS changed
        FROM co x JOIN co y ON y.stream = x.stream + 1 AND y.ch = x.ch AND y.blk = x.blk AND y.p = x.p WHERE x.c != y.c GROUP BY 1"""),
    "output_queue": (output_queue, f"""WITH {SQL}, b AS (SELECT frame, sum(code // 128)::BIGINT AS b FROM s GROUP BY frame), n AS (SELECT frame, sum(b - 26) OVER (ORDER BY frame) AS net FROM b), q AS (SELECT net - least(0, min(net) OVER (ORDER BY frame)) AS depth FROM n)
        SELECT max(depth)::BIGINT AS deepest, sum((depth > 0)::BIGINT)::BIGINT AS busy, count(*) AS frames FROM q"""),
    "clock_network": (clock_network, f"""WITH RECURSIVE {EDGES}, x(root, node, depth) AS (SELECT 'r' || r_regionkey, 'r' || r_regionkey, 0 FROM region WHERE r_regionkey < 2 UNION SELECT root, dst, depth + 1 FROM x JOIN ed ON src = node WHERE src NOT LIKE 's%') SELECT root, depth::INT AS depth, count(*) AS cells FROM x GROUP BY ALL"""),
    "block_attribution": (block_attribution, """WITH n AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL), b AS (SELECT c_nationkey, c_mktsegment AS block FROM n QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) = 1)
        SELECT block, count(*) AS cells, sum((block = c_mktsegment)::BIGINT)::BIGINT AS agree FROM customer JOIN b USING (c_nationkey) GROUP BY block"""),
    "fault_table": (fault_table, "SELECT event_type AS class, count(*) AS faults, sum((value > 50)::BIGINT)::BIGINT AS found, round(avg((value > 50)::INT::DOUBLE), 9) AS share FROM events GROUP BY 1"),
    "retrained_generalisation": (retrained_generalisation, f"""{BASE}, {wavelet.SYMBOLS_SQL}, hf AS (SELECT ch, (max(blk) + 1) / 2 AS half FROM sm GROUP BY ch), n AS (SELECT blk < half AS tr, ctx, sym, count(*) AS n FROM sm JOIN hf USING (ch) GROUP BY ALL), t AS (SELECT ctx, sum(n) AS t FROM n WHERE tr GROUP BY ctx)
        SELECT h.ctx, sum(h.n)::BIGINT AS n, round(sum(-h.n * log2((coalesce(m.n, 0) + 0.5) / (t.t + 32))) / sum(h.n), 6) AS bits_per_symbol FROM n h JOIN t USING (ctx) LEFT JOIN n m ON m.tr AND m.ctx = h.ctx AND m.sym = h.sym WHERE NOT h.tr GROUP BY h.ctx"""),
}
