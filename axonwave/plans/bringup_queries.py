"""Queries of stimulus patterns, hardware words, file ratios, compression summary, fault search and clock roots."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from axonwave.functions import coding
from axonwave.operators import codecs, wavelet
from axonwave.operators.numbering import numbered
from axonwave.operators.graphs import reach
from axonwave.plans.packet_sql import LOSSY_CODED
from axonwave.plans.protocol_queries import EDGES, edges
from axonwave.plans.samples import BLOCKS_SQL, SQL, blocks, packets, packets_sql, samples, table
from axonwave.plans.signal_queries import SNR_SQL, N, snr_percentiles

BASE = f"WITH {SQL}, {BLOCKS_SQL}, {wavelet.forward_sql()}"


def bringup_patterns(spark, d):
    """What each channel of a packet looks like as a test signal: by its different codes, changes, alternations and equal steps; packets and codes of every kind."""
    w = Window.partitionBy("ch", "pkt").orderBy("frame")
    x = packets(samples(spark, d), 256).withColumn("step", F.col("code") - F.lag("code").over(w))
    x = x.withColumn("before", F.lag("step").over(w))
    f = x.groupBy("ch", "pkt").agg(
        F.count_distinct("code").alias("codes"), F.count_if(F.col("step") != 0).alias("changes"), F.count_if((F.col("step") != 0) & (F.col("step") == -F.col("before"))).alias("swings"),
        F.count_if(F.col("step") == F.col("before")).alias("even"), F.sum("code").alias("total"))
    kind = F.when(F.col("codes") == 1, "constant").when((F.col("codes") == 2) & (F.col("swings") >= 127), "square").when(F.col("changes") <= 8, "steps").when(F.col("even") >= 200, "ramp").otherwise("signal")
    return f.groupBy("ch", kind.alias("kind")).agg(F.count("*").alias("packets"), F.sum("changes").alias("changes"), F.sum("swings").alias("swings"), F.sum("even").alias("even"), F.sum("total").alias("total"))


def word(v, bits: int):
    """The low bits of v as an unsigned number."""
    return v.bitwiseAND(F.lit((1 << bits) - 1))


def signed_word(v, bits: int):
    return word(v + (1 << (bits - 1)), bits) - (1 << (bits - 1))


def hardware_words(spark, d):
    """Two's complement words of products of the samples, and the dead-zone quantiser on 13-bit words."""
    x = samples(spark, d).withColumn("v", (F.col("code") - 512) * (F.col("frame") % 41 - 20))
    s = signed_word(F.col("v"), 13)
    out = x.select("ch", word(F.col("v"), 13).alias("u"), s.alias("s"), signed_word(F.signum(s).cast("long") * F.shiftright(word(F.abs(s), 13), 3), 13).alias("q"))
    return out.groupBy("ch").agg(F.sum("u").alias("u"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("q").alias("lo"), F.max("q").alias("hi"))


def file_ratio(spark, d):
    """Ragged files (a user's events each): bits of each from its valid samples, whole bytes and a header of 8 a file, against 16-bit files with a 44-byte header."""
    w = Window.partitionBy("file").orderBy("event_id")
    e = table(spark, d, "events").select(F.col("user_id").alias("file"), "event_id", F.least(F.lit(1023), F.greatest(F.lit(0), F.bround("value", 0).cast("long"))).alias("code"))
    e = e.withColumn("e", F.pmod(F.col("code") - F.lag("code").over(w) + 512, F.lit(1024)) - 512)
    m = wavelet.zigzag(F.col("e"))
    q = F.shiftright(m, 4)
    per = e.groupBy("file").agg(F.count("*").alias("len"), (10 + F.coalesce(F.sum(F.when(q >= 16, 26).otherwise(q + 5)), F.lit(0))).alias("bits"))
    comp = F.sum(F.ceil(F.col("bits") / 8)) + 8 * F.count("*")
    return per.agg(F.count("*").alias("files"), F.sum("len").alias("samples"), comp.alias("n_bytes"), F.round(8 * comp / F.sum("len"), 6).alias("bps"), F.round(F.sum(44 + 2 * F.col("len")) / comp, 6).alias("ratio"))


def compress_summary(spark, d):
    """Pooled bits a sample of mode 1, and median and tenth percentile of the SNR."""
    p = codecs.lossy_packets(samples(spark, d), N)[0].agg(F.sum(F.length("bytes")).alias("n_bytes"), F.count("*").alias("packets"))
    q = snr_percentiles(spark, d).select(F.col("median").alias("snr_median"), F.col("p10").alias("snr_p10"))
    return p.crossJoin(q).select((F.col("packets") * 256 * N).alias("samples"), F.round(8 * F.col("n_bytes") / (F.col("packets") * 256 * N), 6).alias("bps"), "snr_median", "snr_p10")


#: Packets of one block, since the recordings of few users are short.
GROUP_CONFIG = wavelet.LossyConfig(blocks_per_packet=1)


def recordings(spark, d):
    """Users by their number modulo 64 are files, and eight files in order are a recording of eight channels: samples of many streams."""
    e = table(spark, d, "events").select("event_id", (F.col("user_id") % 64).alias("file"), F.least(F.lit(1023), F.greatest(F.lit(0), F.bround("value", 0).cast("long"))).alias("code"))
    x = numbered(e, ["file"], "event_id", "frame")
    return x.select(F.floor(F.col("file") / N).alias("stream"), (F.col("file") % N).cast("int").alias("ch"), "frame", "code")


def compress_groups(spark, d):
    """The compression step by groups of files, with tables of all of them: packets, bits a sample, and the SNR of a group's channels."""
    b = blocks(recordings(spark, d))
    sym = codecs.whole_packets(wavelet.symbols(b, GROUP_CONFIG), N, GROUP_CONFIG)
    p = codecs.encode_lossy(sym, codecs.trained_tables(sym, GROUP_CONFIG), N, GROUP_CONFIG)
    p = p.groupBy("stream").agg(F.count("*").alias("packets"), F.sum(F.length("bytes")).alias("n_bytes"))
    r = wavelet.reconstruction(b)
    mean = r.groupBy("stream", "ch").agg(F.avg("code").alias("mean"))
    c = r.join(mean, ["stream", "ch"]).groupBy("stream", "ch").agg(F.sum((F.col("code") - F.col("mean")) ** 2).alias("s"), F.sum((F.col("y") - F.col("code")) ** 2).alias("e"))
    snr = c.withColumn("snr", 10 * F.log10(F.col("s") / F.greatest(F.col("e"), F.lit(1e-9)))).groupBy("stream").agg(F.round(F.median("snr"), 6).alias("snr_median"), F.round(F.percentile("snr", F.lit(0.1)), 6).alias("snr_p10"))
    return p.join(snr, "stream").select("stream", "packets", "n_bytes", F.round(8 * F.col("n_bytes") / (F.col("packets") * GROUP_CONFIG.block * N), 6).alias("bps"), "snr_median", "snr_p10")


def held_out_files(spark, d):
    """Tables trained on every other recording, on the files of the rest: bits a symbol of each context and recording that the tables have not seen."""
    s = wavelet.symbols(blocks(recordings(spark, d)), GROUP_CONFIG).select("stream", "ctx", "sym")
    t = s.where("stream % 2 = 0").groupBy("ctx", "sym").agg(F.count("*").alias("m"))
    total = t.groupBy("ctx").agg(F.sum("m").alias("t"))
    h = s.where("stream % 2 = 1").groupBy("stream", "ctx", "sym").agg(F.count("*").alias("n"))
    j = h.join(total, "ctx").join(t, ["ctx", "sym"], "left")
    bits = -F.col("n") * F.log2((F.coalesce("m", F.lit(0)) + 0.5) / (F.col("t") + 32))
    return j.groupBy("stream", "ctx").agg(F.sum("n").alias("n"), F.count_if(F.col("m").isNull()).alias("unseen"), F.round(F.sum(bits) / F.sum("n"), 6).alias("bits_per_symbol"))


def fifo_profile(spark, d):
    """Buffer of each channel's symbols: the largest burst (all that is needed if every burst is coded before the next sample), and, at one symbol a frame, the deepest queue and how many frames the last symbol of a block comes after its end."""
    c = wavelet.coefficients(blocks(samples(spark, d)))
    level = F.when(F.col("ctx") == 0, 3).otherwise(F.col("ctx"))
    at = F.least(F.lit(63), F.pow(F.lit(2), level).cast("long") * (F.col("i") + 2) - 2)
    n = c.groupBy("stream", "ch", "blk", at.alias("t")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("stream", "ch", "blk").orderBy("t")
    # a queue that drains one a frame is as deep as the fullest stretch up to here; the last symbol waits for the fullest stretch to the end
    n = n.withColumn("sum", F.sum("n").over(w)).withColumn("base", F.col("sum") - F.col("n") - F.col("t"))
    n = n.withColumn("depth", F.col("sum") - F.col("t") - F.min("base").over(w))
    n = n.withColumn("done", F.col("t") + F.sum("n").over(w.orderBy(F.desc("t"))))
    per = n.groupBy("stream", "ch", "blk").agg(F.max("n").alias("burst"), F.max("depth").alias("depth"), (F.max("done") - 64).alias("lag"))
    return per.groupBy("ch").agg(F.count("*").alias("blocks"), F.max("burst").alias("burst"), F.max("depth").alias("depth"), F.max("lag").alias("lag"))


def _groups_sql() -> str:
    """The SQL of mode 1 over many streams: a packet is a block, named by its stream and number."""
    q = LOSSY_CODED.replace(SQL, """s AS (SELECT user_id % 64 // 8 AS stream, (user_id % 8)::INT AS ch, row_number() OVER (PARTITION BY user_id % 64 ORDER BY event_id) - 1 AS frame, least(1023, greatest(0, round_even(value, 0)::BIGINT)) AS code FROM events)""")
    q = q.replace("PARTITION BY ch, frame // 64", "PARTITION BY stream, ch, frame // 64").replace("blk // 4 AS pkt", "stream * 1000000 + blk AS pkt").replace("= 2048", "= 512")
    return f"""{q}, {wavelet.RECON_SQL}, {wavelet.inverse_sql('dq', 'd')}, rc AS (SELECT stream, ch, code, greatest(0, least(1023, x)) AS y FROM rx),
    mm AS (SELECT stream, ch, avg(code) AS mean FROM rc GROUP BY ALL), sn AS (SELECT stream, ch, 10 * log10(sum((code - mean) ** 2) / greatest(sum(((y - code) ** 2)::DOUBLE), 1e-9)) AS snr FROM rc JOIN mm USING (stream, ch) GROUP BY ALL),
    gs AS (SELECT stream, round(median(snr), 6) AS snr_median, round(quantile_cont(snr, 0.1), 6) AS snr_p10 FROM sn GROUP BY stream),
    gp AS (SELECT pkt // 1000000 AS stream, count(*) AS packets, sum(length(packet) // 2 + 1)::BIGINT AS n_bytes FROM rans_hex GROUP BY 1)
    SELECT stream, packets, n_bytes, round(8 * n_bytes / (packets * 512), 6) AS bps, snr_median, snr_p10 FROM gp JOIN gs USING (stream)"""


COMPRESS_SQL = f"""{LOSSY_CODED}, {SNR_SQL.split(f"{wavelet.forward_sql()}, ", 1)[1]}, np AS (SELECT count(*) AS n, sum(length(packet) // 2 + 1)::BIGINT AS b FROM rans_hex), pc AS (SELECT round(median(snr), 6) AS snr_median, round(quantile_cont(snr, 0.1), 6) AS snr_p10 FROM snr)
SELECT n * 2048 AS samples, round(8 * b / (n * 2048), 6) AS bps, snr_median, snr_p10 FROM np, pc"""


def snr_summary(spark, d):
    """The SNR part of the compression summary."""
    return snr_percentiles(spark, d).select(F.col("median").alias("snr_median"), F.col("p10").alias("snr_p10"))


def energy_figures(spark, d):
    """Energy a sample, power density and radio ratio of each part as if its price were its power in uW and its size its area."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("uw"), F.col("p_size").alias("area"))
    nj = F.col("uw") * 1e-6 / (8 * 19531.0) * 1e9
    return p.select("p_partkey", F.round(nj, 6).alias("nj"), F.round(F.col("uw") * 1e-3 / (F.col("area") / 0.6 * 1e-2), 6).alias("density"), F.round(nj / ((10 - 2.087) * 5.0), 8).alias("radio_ratio"))


def regex_selection(spark, d):
    """Items chosen by a regular expression that have a metric, and those that lack it."""
    p = table(spark, d, "part").where(F.col("p_type").rlike("^(S[MT]|ECO).*[LDY]$"))
    m = table(spark, d, "lineitem").where("l_discount > 0.09").groupBy("l_partkey").agg(F.count("*").alias("m"))
    return p.join(m, F.col("p_partkey") == F.col("l_partkey"), "left").groupBy("p_type").agg(F.count("*").alias("chosen"), F.count("m").alias("with_metric"))


def tdm_methods(spark, d):
    """Bytes of each packet, band by band over channels, under one pooled table, a table a band, and a table from the packet before; read back."""
    s = codecs.whole_packets(wavelet.symbols(blocks(samples(spark, d))), N)
    w = Window.partitionBy("stream", "pkt").orderBy("blk", "ctx", "i", "ch")
    s = s.withColumn("at", F.row_number().over(w) - 1)
    counts = [[0] * 64 for _ in range(4)]
    for r in s.groupBy("ctx", "sym").count().collect():  # 4 x 64 numbers
        counts[r.ctx][r.sym] = r["count"]
    own = [coding.cumulative(coding.normalised(x)) for x in counts]
    pooled = [coding.cumulative(coding.normalised([sum(x) for x in zip(*counts, strict=True)]))]
    first = s.where(F.col("at") < 4096 - 64).groupBy("stream", "pkt", "sym").count().groupBy("stream", (F.col("pkt") + 1).alias("pkt")).agg(F.map_from_entries(F.collect_list(F.struct("sym", "count"))).alias("t"))

    def one(pdf):
        pdf = pdf.sort_values("at")
        ch, ctx, sym, t = pdf.ch.tolist(), pdf.ctx.tolist(), pdf.sym.tolist(), pdf.t.iloc[0]
        before = [coding.cumulative([1 + (dict(t).get(k, 0) if t is not None else 0) for k in range(64)])]
        out, wrong = {}, 0
        for name, tables, of in (("pooled", pooled, [0] * len(ctx)), ("by_band", own, ctx), ("adaptive", before, [0] * len(ctx))):
            order = list(zip(ch, of, strict=True))
            data = coding.rans_packed(order, sym, tables, N, 11)
            wrong += [x for x, _ in coding.rans_unpacked(data, order, tables, N, None, lsh=11, state_bytes=4)] != sym
            out[name] = [len(data)]
        return pd.DataFrame({"pkt": [int(pdf.pkt.iloc[0])], **out, "escape_bits": [16 * sym.count(63)], "wrong": [wrong]})

    return s.join(first, ["stream", "pkt"], "left").groupBy("stream", "pkt").applyInPandas(one, "pkt long, pooled long, by_band long, adaptive long, escape_bits long, wrong long")


def tdm_bound(spark, d):
    """Entropy bound of the band-wise order: bits by band over whole packets, and 16 more for each escape."""
    s = codecs.whole_packets(wavelet.symbols(blocks(samples(spark, d))), N)
    n = s.groupBy("ctx", "sym").agg(F.count("*").alias("n"))
    n = n.withColumn("t", F.sum("n").over(Window.partitionBy("ctx")))
    return n.groupBy("ctx").agg(F.sum("n").alias("n"), F.round(-F.sum(F.col("n") * F.log2(F.col("n") / F.col("t"))), 4).alias("bits"), F.sum(F.when(F.col("sym") == 63, F.col("n")).otherwise(0) * 16).alias("escape_bits"))


def slot_faults(spark, d):
    """Which slot each received channel carries, and whether a frame late: the only one that agrees in every packet.

    Received here: channels 0 and 1 swapped, 2 with the data of 5, 3 a frame late, the others right.
    """
    s = samples(spark, d)
    late = s.select("stream", "ch", (F.col("frame") + 1).alias("frame"), "code")
    carried = F.create_map(*[F.lit(x) for kv in {0: 1, 1: 0, 2: 5}.items() for x in kv])
    got = F.broadcast(spark.range(N).select(F.col("id").cast("int").alias("got"))).withColumn("ch", F.coalesce(carried[F.col("got")], F.col("got")))
    got = s.join(got.where("got != 3"), "ch").select("stream", "got", "frame", "code").unionByName(late.where("ch = 3").select("stream", F.lit(3).alias("got"), "frame", "code"))

    def packets_of(x, key):
        """A digest of each packet of 256 frames of each key, the first frame and short packets left out."""
        x = x.where("frame > 0").groupBy("stream", key, F.floor(F.col("frame") / 256).alias("pkt"))
        text = F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("frame", "code"))), lambda r: r["code"].cast("string")))
        return x.agg(F.count("*").alias("n"), F.md5(text).alias("digest")).where("n >= 255")

    columns = packets_of(s, "ch").withColumn("late", F.lit(False)).unionByName(packets_of(late, "ch").withColumn("late", F.lit(True)))
    seen = packets_of(got, "got")
    of = seen.groupBy("got").agg(F.count("*").alias("of"))
    hits = seen.join(columns, ["stream", "pkt", "n", "digest"]).groupBy("got", "ch", "late").agg(F.count("*").alias("hits"))
    return hits.join(of, "got").where("hits = of").select("got", F.col("ch").alias("carries"), "late", (F.col("got") != F.col("ch")).alias("wrong"))


def shared_stuck(spark, d):
    """Which stuck bit of a net that all channels share explains what was seen (here bit 4 high): it must fit every sample of every channel."""
    s = samples(spark, d).withColumn("seen", F.col("code").bitwiseOR(16))
    h = F.broadcast(spark.range(20).select((F.col("id") % 10).cast("int").alias("bit"), (F.col("id") >= 10).alias("high")))
    mask = F.pow(F.lit(2), F.col("bit")).cast("long")
    model = F.when(F.col("high"), F.col("code").bitwiseOR(mask)).otherwise(F.col("code").bitwiseAND(1023 - mask))
    return s.crossJoin(h).groupBy("bit", "high").agg(F.bool_and(model == F.col("seen")).alias("fits"), F.sum((model != F.col("seen")).cast("long")).alias("differ"))


def flush_faults(spark, d):
    """Packets right up to their final states: which channels' states differ, and by which bits (here bit pkt mod 24 of channel pkt mod 8)."""
    p = codecs.lossy_packets(samples(spark, d), N)[0].select("pkt", "bytes")

    def many(batches):
        for pdf in batches:
            out = []
            for pkt, raw in zip(pdf.pkt.tolist(), pdf.bytes.tolist(), strict=True):
                want, got, cut = bytes(raw), bytearray(raw), len(raw) - 3 * N
                got[cut + 3 * (pkt % N) + pkt % 24 // 8] ^= 1 << pkt % 8
                states = [[int.from_bytes(x[cut + 3 * c : cut + 3 * c + 3], "little") for c in range(N)] for x in (want, got)]
                bad = [(c, a ^ b) for c, (a, b) in enumerate(zip(*states, strict=True)) if a != b]
                kind = "flush" if want[:cut] == bytes(got[:cut]) and bad else "payload" if bad else "clean"
                out.append((pkt, kind, len(bad), bad[0][0], bad[0][1].bit_length() - 1, bad[0][1].bit_count()))
            yield pd.DataFrame(out, columns=["pkt", "kind", "channels", "ch", "bit", "bits"])

    return p.mapInPandas(many, "pkt long, kind string, channels long, ch long, bit long, bits long")


def choose_packet(spark, d):
    """Which expected packet a received one is: the continuation, or what its sequence number claims; the better share of equal codes, ties to the claim."""
    s = samples(spark, d).withColumn("pkt", F.floor(F.col("frame") / 256))
    pkt = s.groupBy("pkt").agg(F.count("*").alias("n")).where(F.col("n") == 256 * N).select("pkt")
    # received: every third packet was skipped, so that from then on the sequence claims more than the count
    got = numbered(pkt.where("pkt % 3 != 2").withColumn("all", F.lit(0)), ["all"], "pkt", "next").drop("all")
    cand = got.select("pkt", "next", F.explode(F.array_distinct(F.array("next", F.col("next") + F.pmod(F.col("pkt") - F.col("next"), F.lit(64))))).alias("k"))
    a = s.select("pkt", "ch", F.pmod("frame", F.lit(256)).alias("f"), "code")
    b = a.select(F.col("pkt").alias("k"), "ch", "f", F.col("code").alias("want"))
    score = cand.join(a, "pkt").join(b, ["k", "ch", "f"]).groupBy("pkt", "next", "k").agg(F.round(F.avg((F.col("code") == F.col("want")).cast("double")), 9).alias("score"))
    best = score.groupBy("pkt").agg(F.max(F.struct("score", (F.col("k") != F.col("next")).alias("claim"), "k")).alias("b"))
    return best.select("pkt", F.col("b.k").alias("chosen"), F.col("b.score").alias("score"))


def clock_roots(spark, d):
    """For each root (a port, or a gate's output): buffers below it down to the next gate, sinks, child gates and depth."""
    e = edges(spark, d)
    gate = lambda c: c.rlike("^n[0-9]*[05]$")
    buffer = lambda c: c.rlike("^n[0-9]*[1-46-9]$|^s[0-9]*[02468]$")
    ports = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"))
    gates = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node")).where(gate(F.col("node")))
    roots = ports.unionByName(gates)
    # a root's own edges, then those of buffers only: the nodes on the way carry the root's mark by reach()
    onward = e.where(buffer(F.col("src"))).unionByName(e.join(roots, e.src == roots.node, "left_semi").withColumn("src", F.concat(F.lit("@"), "src")))
    start = roots.select(F.concat(F.lit("@"), "node").alias("node"))
    r = reach(start, onward).where("depth > 0").withColumn("root", F.substring("root", 2, 100))
    is_gate, is_buffer = gate(F.col("node")), buffer(F.col("node"))
    found = r.groupBy("root").agg(F.sum(is_buffer.cast("long")).alias("buffers"), F.sum(is_gate.cast("long")).alias("child_gates"), F.sum((~is_gate & ~is_buffer).cast("long")).alias("sinks"), F.max(F.when(is_buffer, F.col("depth")).otherwise(0)).alias("depth"))
    return roots.select(F.col("node").alias("root")).join(found, "root", "left").na.fill(0)


PATTERNS_SQL = f"""WITH {SQL}, {packets_sql(256)}, x AS (SELECT *, code - lag(code) OVER (PARTITION BY ch, pkt ORDER BY frame) AS step FROM k), y AS (SELECT *, lag(step) OVER (PARTITION BY ch, pkt ORDER BY frame) AS prev FROM x),
    f AS (SELECT ch, pkt, count(DISTINCT code) AS codes, count(*) FILTER (step != 0) AS changes, count(*) FILTER (step != 0 AND step = -prev) AS swings, count(*) FILTER (step = prev) AS even, sum(code)::BIGINT AS total FROM y GROUP BY ch, pkt)
    SELECT ch, CASE WHEN codes = 1 THEN 'constant' WHEN codes = 2 AND swings >= 127 THEN 'square' WHEN changes <= 8 THEN 'steps' WHEN even >= 200 THEN 'ramp' ELSE 'signal' END AS kind, count(*) AS packets,
        sum(changes)::BIGINT AS changes, sum(swings)::BIGINT AS swings, sum(even)::BIGINT AS even, sum(total)::BIGINT AS total FROM f GROUP BY 1, 2"""

QUERIES = {
    "bringup_patterns": (bringup_patterns, PATTERNS_SQL),
    "hardware_words": (hardware_words, f"""WITH {SQL}, v AS (SELECT ch, (code - 512) * (frame % 41 - 20) AS v FROM s), w AS (SELECT ch, v & 8191 AS u, ((v + 4096) & 8191) - 4096 AS s FROM v),
        q AS (SELECT ch, u, s, (((sign(s)::BIGINT * ((abs(s) & 8191) >> 3)) + 4096) & 8191) - 4096 AS q FROM w) SELECT ch, sum(u)::BIGINT AS u, sum(s)::BIGINT AS s, sum(q)::BIGINT AS q, min(q) AS lo, max(q) AS hi FROM q GROUP BY ch"""),
    "file_ratio": (file_ratio, """WITH c AS (SELECT user_id AS file, event_id, least(1023, greatest(0, round_even(value, 0)::BIGINT)) AS code FROM events), e AS (SELECT file, (code - lag(code) OVER (PARTITION BY file ORDER BY event_id) + 1536) % 1024 - 512 AS e FROM c),
        m AS (SELECT file, CASE WHEN e >= 0 THEN 2 * e ELSE -2 * e - 1 END >> 4 AS q FROM e), f AS (SELECT file, count(*) AS len, 10 + coalesce(sum(CASE WHEN q < 16 THEN q + 5 WHEN q IS NOT NULL THEN 26 END), 0) AS bits FROM m GROUP BY file),
        t AS (SELECT count(*) AS files, sum(len) AS samples, sum((bits + 7) // 8) + 8 * count(*) AS n, sum(44 + 2 * len) AS wav FROM f) SELECT files, samples::BIGINT AS samples, n::BIGINT AS n_bytes, round(8 * n / samples, 6) AS bps, round(wav / n, 6) AS ratio FROM t"""),
    "compress_summary": (compress_summary, COMPRESS_SQL),
    "compress_groups": (compress_groups, _groups_sql()),
    "held_out_files": (held_out_files, f"""{_groups_sql().split(", wsm AS")[0]}, t AS (SELECT ctx, sym, count(*) AS m FROM sm WHERE stream % 2 = 0 GROUP BY ALL), tt AS (SELECT ctx, sum(m) AS t FROM t GROUP BY ctx),
        h AS (SELECT stream, ctx, sym, count(*) AS n FROM sm WHERE stream % 2 = 1 GROUP BY ALL) SELECT stream, h.ctx, sum(n)::BIGINT AS n, count(*) FILTER (m IS NULL) AS unseen, round(sum(-n * log2((coalesce(m, 0) + 0.5) / (tt.t + 32))) / sum(n), 6) AS bits_per_symbol
        FROM h JOIN tt ON tt.ctx = h.ctx LEFT JOIN t ON t.ctx = h.ctx AND t.sym = h.sym GROUP BY ALL"""),
    "fifo_profile": (fifo_profile, f"""{BASE}, n AS (SELECT ch, blk, least(63, (1 << CASE WHEN ctx = 0 THEN 3 ELSE ctx END) * (i + 2) - 2) AS t, count(*) AS n FROM cq GROUP BY ALL), a AS (SELECT *, sum(n) OVER (PARTITION BY ch, blk ORDER BY t) AS s, t + sum(n) OVER (PARTITION BY ch, blk ORDER BY t DESC) AS done FROM n),
        q AS (SELECT *, s - t - min(s - n - t) OVER (PARTITION BY ch, blk ORDER BY t) AS depth FROM a), p AS (SELECT ch, blk, max(n) AS burst, max(depth) AS depth, max(done) - 64 AS lag FROM q GROUP BY ch, blk)
        SELECT ch, count(*) AS blocks, max(burst) AS burst, max(depth)::BIGINT AS depth, max(lag)::BIGINT AS lag FROM p GROUP BY ch"""),
    "snr_summary": (snr_summary, f"{SNR_SQL} SELECT round(median(snr), 6) AS snr_median, round(quantile_cont(snr, 0.1), 6) AS snr_p10 FROM snr"),
    "energy_figures": (energy_figures, "SELECT p_partkey, round(p_retailprice * 1e-6 / (8 * 19531.0::DOUBLE) * 1e9, 6) AS nj, round(p_retailprice * 1e-3 / (p_size / 0.6::DOUBLE * 1e-2), 6) AS density, round(p_retailprice * 1e-6 / (8 * 19531.0::DOUBLE) * 1e9 / ((10 - 2.087::DOUBLE) * 5.0::DOUBLE), 8) AS radio_ratio FROM part"),
    "regex_selection": (regex_selection, "SELECT p_type, count(*) AS chosen, count(m) AS with_metric FROM part LEFT JOIN (SELECT l_partkey, count(*) AS m FROM lineitem WHERE l_discount > 0.09 GROUP BY 1) ON l_partkey = p_partkey WHERE regexp_matches(p_type, '^(S[MT]|ECO).*[LDY]$') GROUP BY 1"),
    "tdm_methods": (tdm_methods, None),
    "tdm_bound": (tdm_bound, f"{BASE}, {wavelet.SYMBOLS_SQL}, w AS (SELECT * FROM sm QUALIFY count(*) OVER (PARTITION BY pkt) = 2048), n AS (SELECT ctx, sym, count(*) AS n FROM w GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY ctx) AS t FROM n) SELECT ctx, sum(n)::BIGINT AS n, round(-sum(n * log2(n / t)), 4) AS bits, sum(CASE WHEN sym = 63 THEN 16 * n ELSE 0 END)::BIGINT AS escape_bits FROM t GROUP BY ctx"),
    "slot_faults": (slot_faults, f"""WITH {SQL}, la AS (SELECT ch, frame + 1 AS frame, code FROM s), x AS (SELECT ch, false AS late, frame, code FROM s UNION ALL SELECT ch, true, frame, code FROM la),
        g AS (SELECT r.got, s.frame, s.code FROM s JOIN (VALUES (0, 1), (1, 0), (2, 5), (4, 4), (5, 5), (6, 6), (7, 7)) r(got, ch) USING (ch) UNION ALL SELECT 3, frame, code FROM la WHERE ch = 3),
        cp AS (SELECT ch, late, frame // 256 AS pkt, count(*) AS n, string_agg(code::VARCHAR, ',' ORDER BY frame) AS t FROM x WHERE frame > 0 GROUP BY ALL HAVING count(*) >= 255),
        gp AS (SELECT got, frame // 256 AS pkt, count(*) AS n, string_agg(code::VARCHAR, ',' ORDER BY frame) AS t FROM g WHERE frame > 0 GROUP BY ALL HAVING count(*) >= 255), o AS (SELECT got, count(*) AS n FROM gp GROUP BY got),
        h AS (SELECT got, ch, late, count(*) AS hits FROM gp JOIN cp USING (pkt, n, t) GROUP BY ALL) SELECT got::INT AS got, ch AS carries, late, got != ch AS wrong FROM h JOIN o USING (got) WHERE hits = o.n"""),
    "shared_stuck": (shared_stuck, f"""WITH {SQL}, h AS (SELECT (i % 10)::INT AS bit, i >= 10 AS high FROM range(20) t(i)), m AS (SELECT bit, high, (code | 16) != CASE WHEN high THEN code | (1 << bit) ELSE code & (1023 - (1 << bit)) END AS differs FROM s, h)
        SELECT bit, high, NOT bool_or(differs) AS fits, sum(differs::BIGINT)::BIGINT AS differ FROM m GROUP BY ALL"""),
    "flush_faults": (flush_faults, None),
    "choose_packet": (choose_packet, f"""WITH {SQL}, a AS (SELECT frame // 256 AS pkt, ch, frame % 256 AS f, code FROM s), p AS (SELECT pkt FROM a GROUP BY pkt HAVING count(*) = 2048), g AS (SELECT pkt, row_number() OVER (ORDER BY pkt) - 1 AS nx FROM p WHERE pkt % 3 != 2),
        c AS (SELECT DISTINCT pkt, nx, k FROM (SELECT pkt, nx, unnest([nx, nx + (pkt - nx) % 64]) AS k FROM g)), sc AS (SELECT c.pkt, nx, k, round(avg((a.code = b.code)::INT::DOUBLE), 9) AS score FROM c JOIN a ON a.pkt = c.pkt JOIN a b ON b.pkt = c.k AND b.ch = a.ch AND b.f = a.f GROUP BY ALL)
        SELECT pkt, arg_max(k, (score, k != nx, k)) AS chosen, max(score) AS score FROM sc GROUP BY pkt"""),
    "clock_roots": (clock_roots, f"""WITH RECURSIVE {EDGES}, ro AS (SELECT 'r' || r_regionkey AS root FROM region UNION ALL SELECT 'n' || n_nationkey FROM nation WHERE n_nationkey % 5 = 0),
        x(root, node, depth) AS (SELECT root, dst, 1 FROM ro JOIN ed ON src = root UNION SELECT root, dst, depth + 1 FROM x JOIN ed ON src = node WHERE regexp_matches(node, '^n[0-9]*[1-46-9]$|^s[0-9]*[02468]$')),
        y AS (SELECT root, regexp_matches(node, '^n[0-9]*[05]$') AS g, regexp_matches(node, '^n[0-9]*[1-46-9]$|^s[0-9]*[02468]$') AS b, min(depth) AS depth FROM x GROUP BY root, node)
        SELECT root, coalesce(sum(b::BIGINT), 0)::BIGINT AS buffers, coalesce(sum(g::BIGINT), 0)::BIGINT AS child_gates, coalesce(sum((NOT g AND NOT b)::BIGINT), 0)::BIGINT AS sinks, coalesce(max(CASE WHEN b THEN depth ELSE 0 END), 0)::INT AS depth FROM ro LEFT JOIN y USING (root) GROUP BY root"""),
}
