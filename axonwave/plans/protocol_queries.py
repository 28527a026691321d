"""Queries of the packet stream protocol, scoreboard, diagnosis, graph, activity and scoring families."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from axonwave.operators import wavelet
from axonwave.operators.graphs import block_labels, majority, reach
from axonwave.operators.latency import delivery_latency
from axonwave.plans.samples import BLOCKS_SQL, SQL, blocks, samples, table
from axonwave.sources import netlist
from axonwave.sources.folders import new_folder
from axonwave.plans.signal_queries import RICE_SQL, rice_adaptive_bits

BASE = f"WITH {SQL}, {BLOCKS_SQL}, {wavelet.forward_sql()}"


def received(spark, d):
    """A received stream from events: every user is a stream, every event a packet, some of which are lost."""
    e = table(spark, d, "events").select("event_id", "user_id", "value", "event_type")
    k = e.withColumn("k", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long"))
    return k.withColumns({"seq": F.pmod("k", F.lit(64)).cast("int"), "lost": F.pmod(F.col("event_id") * 31, F.lit(11)) == 0})


RECEIVED = """r AS (SELECT event_id, user_id, value, event_type, k, (k % 64)::INT AS seq, (event_id * 31) % 11 = 0 AS lost FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events))"""


def sequence_unwrap(spark, d):
    """Packet numbers from 6-bit sequence numbers: the running sum of steps modulo 64; gaps are losses."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    g = received(spark, d).where("NOT lost")
    g = g.withColumn("step", F.pmod(F.col("seq") - F.coalesce(F.lag("seq").over(w), F.lit(-1)), F.lit(64)))
    g = g.withColumn("n", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return g.groupBy("user_id").agg(F.count("*").alias("got"), F.sum(F.col("step") - 1).cast("long").alias("missing"), F.sum((F.col("n") != F.col("k")).cast("long")).alias("wrong"))


def lost_packets(spark, d):
    r = received(spark, d)
    return r.select("user_id", "k").join(r.where("NOT lost").select("user_id", "k"), ["user_id", "k"], "left_anti")


def expected_vs_received(spark, d):
    r = received(spark, d)
    want = r.where("event_type != 'click'").select("user_id", "k", F.lit(1).alias("want"))
    got = r.where("NOT lost").select("user_id", "k", F.lit(1).alias("got"))
    kind = F.when(F.col("want").isNull(), "unexpected").when(F.col("got").isNull(), "lost").otherwise("matched")
    return want.join(got, ["user_id", "k"], "full").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def packet_split(spark, d):
    """Bytes of a token stream to packets: a packet ends with its last byte or an abort token."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    end = F.when(F.col("event_type") == "purchase", "complete").when(F.pmod("event_id", F.lit(37)) == 0, "aborted")
    t = received(spark, d).withColumn("end", end)
    t = t.withColumn("pkt", F.coalesce(F.sum(F.col("end").isNotNull().cast("long")).over(w), F.lit(0)))
    p = t.groupBy("user_id", "pkt").agg(F.count("*").alias("n"), F.coalesce(F.max("end"), F.lit("eof")).alias("status"))
    return p.groupBy("status").agg(F.count("*").alias("packets"), F.sum("n").alias("tokens"))


def segments(spark, d):
    """Enable periods: gaps and islands over an enable flag."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    on = F.col("value") > 100
    t = received(spark, d).withColumn("on", on).withColumn("start", (F.col("on") & ~F.coalesce(F.lag(on).over(w), F.lit(False))).cast("long"))
    t = t.withColumn("seg", F.sum("start").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("on")
    s = t.groupBy("user_id", "seg").agg(F.count("*").alias("n"), F.max((F.col("value") > 480).cast("int")).alias("overflow"))
    return s.groupBy("user_id").agg(F.count("*").alias("segments"), F.max("n").alias("longest"), F.sum("overflow").alias("overflows"))


def queue_latency(spark, d):
    """The n-th push of a channel is answered by its n-th pop."""
    r = received(spark, d)
    order = Window.partitionBy("user_id").orderBy("event_id")
    push = r.where("event_type IN ('click', 'view')").select("user_id", F.row_number().over(order).alias("n"), F.col("event_id").alias("t0"))
    pop = r.where("event_type IN ('purchase', 'signup')").select("user_id", F.row_number().over(order).alias("n"), F.col("event_id").alias("t1"))
    j = push.join(pop, ["user_id", "n"]).withColumn("lat", F.abs(F.col("t1") - F.col("t0")))
    return j.agg(F.count("*").alias("n"), F.median("lat").alias("median"), F.max("lat").alias("most"), F.percentile("lat", F.lit(0.9)).alias("p90"))


def bytes_histogram(spark, d):
    b = received(spark, d).groupBy("user_id", F.floor(F.col("k") / 4).alias("frame")).agg(F.sum(F.floor(F.col("value") / 50)).alias("bytes"))
    return b.groupBy("bytes").agg(F.count("*").alias("frames"))


BINS = [f"slots_{i}" for i in range(1, 9)] + ["abort", "resume", "overflow", "wrap", "idle"]


def coverage(spark, d):
    """Bins hit over all runs, and the bins that no run has hit."""
    want = spark.createDataFrame([(b,) for b in BINS], "bin string")
    e = table(spark, d, "events")
    hit = F.when(F.col("value") > 489, "overflow").when(F.col("user_id") % 10 < 7, F.concat(F.lit("slots_"), (F.col("user_id") % 10 + 1).cast("string"))).otherwise("wrap")
    n = e.groupBy(hit.alias("bin")).agg(F.count("*").alias("n"))
    return want.join(n, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("missing"))


def coverage_missing(spark, d):
    return coverage(spark, d).where("missing").select("bin")


def linear_fit(spark, d):
    return table(spark, d, "lineitem").groupBy("l_linenumber").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 2).alias("intercept"))


def power_by_class(spark, d):
    """Instances joined with their classes, power by class and as a share of all."""
    li, p = table(spark, d, "lineitem").select("l_partkey", "l_quantity"), table(spark, d, "part").select("p_partkey", "p_brand")
    n = li.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
    return n.select(F.col("p_brand").alias("class"), F.round("q", 2).alias("power"), "n", F.round(F.col("q") / F.sum("q").over(Window.partitionBy()), 8).alias("share"))


def majority_vote(spark, d):
    """The most frequent class of each block, the smallest on ties."""
    c = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("n"), "o_orderpriority"))
    return c.withColumn("r", r).where("r = 1").select("o_custkey", "o_orderpriority", "n")


def top_per_group(spark, d):
    """Ten slowest and top 25 by two keys."""
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("leaves"), F.max("o_orderdate").alias("last")).orderBy(F.desc("leaves"), F.desc("last"), "o_custkey").limit(25).select("o_custkey", "leaves")


def nulls_last_order(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("uw")), F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.orderBy(F.col("uw").asc_nulls_last(), "c_custkey").limit(20).select("c_custkey", F.round("uw", 2).alias("uw"))


def break_even(spark, d):
    """Energy of radio saved against energy of coding, at the rate of each recorded packet."""
    p = rice_adaptive_bits(spark, d).groupBy("pkt").agg((F.sum("bits") / 1024).alias("bps"))
    net = (10 - F.col("bps")) * F.lit(5.0) - F.lit(13.35)
    return p.select("pkt", "bps", F.round(net, 6).alias("net_nj"), (net > 0).alias("pays"), F.round((10 - F.col("bps")) * 5.0, 6).alias("budget_nj"))


def symbols_hit(spark, d):
    """Symbols of each context that occur, and how many of 64 are missing."""
    s = wavelet.symbols(blocks(samples(spark, d))).select("ctx", "sym").distinct()
    return s.groupBy("ctx").agg(F.count("*").alias("hit"), (64 - F.count("*")).alias("missing"))


def symbols_missing(spark, d):
    every = spark.range(256).select((F.col("id") / 64).cast("int").alias("ctx"), F.pmod("id", F.lit(64)).cast("int").alias("sym"))
    return every.exceptAll(wavelet.symbols(blocks(samples(spark, d))).select("ctx", "sym").distinct())


def candidates_of_all(spark, d):
    """Intersection over packets: symbols that every packet of a context has."""
    s = wavelet.symbols(blocks(samples(spark, d)))
    n = s.select("pkt").distinct().count()
    return s.groupBy("ctx", "sym").agg(F.count_distinct("pkt").alias("pkts")).where(F.col("pkts") == n).select("ctx", "sym")


BUDGETS = [("bits_per_sample", 2.2, 2.1, "<=", 2.0867), ("snr_median", 17.0, 18.0, ">=", 18.0027), ("latency_us", 2253.0, 1900.0, "<=", 1846.0), ("delivery_ms", 40.0, 20.0, "<=", None), ("unused", 1.0, 1.0, "<=", None)]


def scored(metrics, spark):
    """Metrics against limit, target and baseline: FAIL, WARN, PASS, INFO without a budget, N/A without a value."""
    b = F.broadcast(spark.createDataFrame(BUDGETS, "name string, limit double, target double, cmp string, base double"))
    v, low = F.col("value"), F.col("cmp") == "<="
    meets = lambda ref: F.when(low, v <= F.col(ref)).otherwise(v >= F.col(ref))
    worse = F.when(low, v - F.col("base")).otherwise(F.col("base") - v) / F.abs("base")
    status = F.when(v.isNull(), "N/A").when(F.col("limit").isNull(), "INFO").when(~meets("limit"), "FAIL").when(~meets("target"), "WARN").when(worse > 0.1, "WARN").otherwise("PASS")
    return metrics.join(b, "name", "left").select("run", "name", "value", status.alias("status"))


def _metrics(spark, d):
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("run")).agg(F.avg("value").alias("v"), F.count("*").alias("n"))
    one = lambda name, c: e.select("run", F.lit(name).alias("name"), F.round(c, 6).alias("value"))
    out = one("bits_per_sample", F.col("v") / 120).unionByName(one("snr_median", F.col("v") / 14)).unionByName(one("latency_us", F.col("n").cast("double")))
    return out.unionByName(one("other", F.col("v"))).unionByName(one("delivery_ms", F.lit(None).cast("double")))


def budget_scores(spark, d):
    return scored(_metrics(spark, d), spark).select("run", "name", "status")


def overall_scores(spark, d):
    rank = F.array_position(F.array(*map(F.lit, ("PASS", "INFO", "N/A", "WARN", "FAIL"))), F.col("status"))
    return scored(_metrics(spark, d), spark).groupBy("run").agg(F.max_by("status", rank).alias("overall"))


METRICS_SQL = """e AS (SELECT event_type AS run, avg(value) AS v, count(*) AS n FROM events GROUP BY 1),
m AS (SELECT run, 'bits_per_sample' AS name, round(v / 120, 6) AS value FROM e UNION ALL SELECT run, 'snr_median', round(v / 14, 6) FROM e UNION ALL SELECT run, 'latency_us', n::DOUBLE FROM e
  UNION ALL SELECT run, 'other', round(v, 6) FROM e UNION ALL SELECT run, 'delivery_ms', NULL FROM e),
bu(name, lim, target, cmp, base) AS (VALUES ('bits_per_sample', 2.2, 2.1, '<=', 2.0867), ('snr_median', 17.0, 18.0, '>=', 18.0027), ('latency_us', 2253.0, 1900.0, '<=', 1846.0), ('delivery_ms', 40.0, 20.0, '<=', NULL)),
sc AS (SELECT run, m.name, CASE WHEN value IS NULL THEN 'N/A' WHEN lim IS NULL THEN 'INFO' WHEN NOT CASE cmp WHEN '<=' THEN value <= lim ELSE value >= lim END THEN 'FAIL'
  WHEN NOT CASE cmp WHEN '<=' THEN value <= target ELSE value >= target END THEN 'WARN' WHEN CASE cmp WHEN '<=' THEN value - base ELSE base - value END / abs(base) > 0.1 THEN 'WARN' ELSE 'PASS' END AS status
  FROM m LEFT JOIN bu ON bu.name = m.name)"""


def edges(spark, d):
    """A net graph: region -> nation -> supplier, and nation -> customer for leaves."""
    n, s, c = table(spark, d, "nation"), table(spark, d, "supplier"), table(spark, d, "customer")
    e = n.select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"))
    e = e.unionByName(s.select(F.concat(F.lit("n"), "s_nationkey").alias("src"), F.concat(F.lit("s"), "s_suppkey").alias("dst")))
    return e.unionByName(c.select(F.concat(F.lit("s"), F.pmod("c_custkey", F.lit(10))).alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst")))


def fanout_trees(spark, d):
    """Leaves, buffers and depth below every root of the graph."""
    e = edges(spark, d)
    roots = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"))
    r = reach(roots, e)
    inner = e.select(F.col("src").alias("node")).distinct().withColumn("buffer", F.lit(1))
    r = r.where("depth > 0").join(inner, "node", "left")
    return r.groupBy("root").agg(F.sum(F.when(F.col("buffer").isNull(), 1).otherwise(0)).alias("leaves"), F.coalesce(F.sum("buffer"), F.lit(0)).alias("buffers"), F.max("depth").alias("depth"))


EDGES = """ed AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION ALL SELECT 's' || c_custkey % 10, 'c' || c_custkey FROM customer)"""


def nearest_named(spark, d):
    """Nearest ancestor with a name (an even nation) of every leaf, within 4 hops upstream."""
    e = edges(spark, d)
    up = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    leaves = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"))
    r = reach(leaves, up, 4).where(F.col("node").rlike("^n[0-9]*[02468]$"))
    return r.groupBy("root").agg(F.min(F.struct("depth", "node")).alias("m")).select("root", F.col("m.node").alias("named"), F.col("m.depth").alias("hops"))


def unconnected(spark, d):
    """Cells without a driver: suppliers of no customer."""
    e = edges(spark, d)
    return table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("cell")).join(e, F.col("cell") == F.col("src"), "left_anti")


def cell_classes(spark, d):
    c = F.when(F.col("p_type").rlike("BRASS$"), "flop").when(F.col("p_type").rlike("^(STANDARD|SMALL)"), "buffer").when(F.col("p_type").rlike("COPPER|TIN"), "gate").otherwise("logic")
    return table(spark, d, "part").groupBy(c.alias("class")).agg(F.count("*").alias("n"), F.sum("p_size").alias("area"))


def switching_activity(spark, d):
    """Toggles of each net between neighbouring changes, and time high; undefined values (below 20) are not changes."""
    v = F.when(F.col("value") >= 20, (F.col("value") > 250).cast("int"))
    t = table(spark, d, "events").select(F.col("user_id").alias("net"), F.col("event_id").alias("t"), v.alias("v")).where("v IS NOT NULL")
    w = Window.partitionBy("net").orderBy("t")
    t = t.withColumns({"was": F.lag("v").over(w), "next": F.lead("t").over(w)})
    return t.groupBy("net").agg(F.sum((F.col("was") != F.col("v")).cast("long")).alias("toggles"), F.sum(F.when(F.col("v") == 1, F.col("next") - F.col("t"))).alias("high"))


def sampled_activity(spark, d):
    """Values as of each clock edge (every 64 ticks), and how often they differ from edge to edge."""
    t = table(spark, d, "events").select(F.col("user_id").alias("net"), F.col("event_id").alias("t"), (F.col("value") > 250).cast("int").alias("v"))
    at = t.groupBy("net", F.floor(F.col("t") / 64).alias("edge")).agg(F.max_by("v", "t").alias("v"))
    w = Window.partitionBy("net").orderBy("edge")
    return at.withColumn("was", F.lag("v").over(w)).groupBy("net").agg(F.count("*").alias("edges"), F.sum((F.col("was") != F.col("v")).cast("long")).alias("toggles"))


def slew_violations(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return li.groupBy(F.col("l_returnflag").alias("corner")).agg(F.sum((F.col("l_discount") > 0.08).cast("long")).alias("total"), F.sum(((F.col("l_discount") > 0.08) & (F.col("s_nationkey") < 5)).cast("long")).alias("clock"))


def stuck_bits(spark, d):
    """Bits of a byte stream that never change, and its number of different bytes."""
    b = table(spark, d, "events").select("user_id", (F.floor("value").cast("int").bitwiseAND(127)).alias("b"))
    return b.groupBy("user_id").agg(F.count_distinct("b").alias("kinds"), F.expr("bit_and(b)").alias("always"), F.expr("bit_or(b)").alias("ever"))


def first_difference(spark, d):
    """Place of the first byte that differs between a packet and what was expected, and the difference in length."""
    r = received(spark, d).withColumn("want", F.floor("value"))
    got = F.when(F.pmod("event_id", F.lit(53)) == 0, F.col("want") + 1).otherwise(F.col("want"))
    r = r.withColumn("got", F.when(~F.col("lost"), got)).withColumn("differs", ~F.col("got").eqNullSafe(F.col("want")))
    return r.groupBy("user_id").agg(F.min(F.when(F.col("differs"), F.col("k"))).alias("first"), F.sum(F.col("got").isNull().cast("long")).alias("short"))


def sequence_fault(spark, d):
    """Constant exclusive-or between claimed and true sequence numbers means a stuck bit; a constant difference, an offset."""
    r = received(spark, d).withColumn("claim", F.when(F.pmod("user_id", F.lit(3)) == 0, F.col("seq").bitwiseXOR(4)).when(F.pmod("user_id", F.lit(3)) == 1, F.pmod(F.col("seq") + 5, F.lit(64))).otherwise(F.col("seq")))
    x = r.groupBy("user_id").agg(F.count_distinct(F.col("claim").bitwiseXOR(F.col("seq"))).alias("xors"), F.max(F.bit_count(F.col("claim").bitwiseXOR(F.col("seq")))).alias("bits"), F.count_distinct(F.pmod(F.col("claim") - F.col("seq"), F.lit(64))).alias("steps"))
    kind = F.when((F.col("xors") == 1) & (F.col("bits") == 0), "ok").when((F.col("xors") == 1) & (F.col("bits") == 1), "flipped bit").when(F.col("steps") == 1, "offset").otherwise("unclear")
    return x.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def stuck_hypotheses(spark, d):
    """Which single stuck bit of a code explains what was seen: every hypothesis against every channel, exact match only."""
    s = samples(spark, d)
    seen = F.when(F.col("ch") == 2, F.col("code").bitwiseOR(8)).when(F.col("ch") == 5, F.col("code").bitwiseAND(1023 - 64)).otherwise(F.col("code"))
    s = s.withColumn("seen", seen)
    h = F.broadcast(spark.range(20).select((F.col("id") % 10).cast("int").alias("bit"), (F.col("id") >= 10).alias("high")))
    mask = F.pow(F.lit(2), F.col("bit")).cast("long")
    model = F.when(F.col("high"), F.col("code").bitwiseOR(mask)).otherwise(F.col("code").bitwiseAND(1023 - mask))
    return s.join(h).groupBy("ch", "bit", "high").agg(F.bool_and(model == F.col("seen")).alias("fits")).where("fits").select("ch", "bit", "high")


def worst_verdict(spark, d):
    """First finding by a fixed rank of kinds."""
    ranks = {"signup": 0, "purchase": 1, "error": 2, "click": 3}
    r = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
    e = table(spark, d, "events").withColumn("rank", F.coalesce(r[F.col("event_type")], F.lit(9)))
    return e.groupBy("user_id").agg(F.min(F.struct("rank", "event_id", "event_type")).alias("m")).select("user_id", F.col("m.event_type").alias("verdict"), F.col("m.event_id").alias("packet"))


R = f"WITH {RECEIVED}"
def _trade(spark, d):
    """A graph of all orders: supplier -> part -> order -> customer."""
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    e = l.select(node("s", "l_suppkey").alias("src"), node("p", "l_partkey").alias("dst")).unionByName(l.select(node("p", "l_partkey").alias("src"), node("o", "l_orderkey").alias("dst")))
    return e.unionByName(o.select(node("o", "o_orderkey").alias("src"), node("c", "o_custkey").alias("dst"))).distinct()


def labelled_blocks(spark, d):
    """Blocks of anonymous nodes: the nearest name downstream (a few customers have one), else upstream (some suppliers have), and each brand's block by most of its parts."""
    c, s, p = (table(spark, d, t) for t in ("customer", "supplier", "part"))
    names = c.where("c_custkey % 97 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.concat(F.lit("seg "), "c_mktsegment").alias("label"))
    names = names.unionByName(s.where("s_suppkey % 7 = 0").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.concat(F.lit("nation "), "s_nationkey").alias("label")))
    parts = p.select(F.concat(F.lit("p"), "p_partkey").alias("node"), F.col("p_brand").alias("group"))
    blocks_ = block_labels(_trade(spark, d), parts, names, down=2, up=1)
    ways = parts.join(blocks_, "node").groupBy("group").agg(F.count_if(F.col("way") == "down").alias("down"), F.count_if(F.col("way") == "up").alias("up"), F.count_if(F.col("way") == "none").alias("none"))
    return majority(parts, blocks_).join(ways, "group")


def delivery_latencies(spark, d):
    """Processing and delivery latency by stream: clicks and views are samples, purchases and errors symbols, signups packet ends; a symbol two samples on still depends on one."""
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("clock"), "event_type")
    of = lambda *kinds: e.where(F.col("event_type").isin(*kinds)).drop("event_type")
    x = delivery_latency(of("click", "view"), of("purchase", "error"), of("signup"), ["user_id"], 2)
    return x.groupBy("user_id").agg(F.count("*").alias("samples"), F.sum("processing").alias("processing"), F.max("processing").alias("most"), F.count("ended").alias("delivered"), F.sum("delivery").alias("delivery"), F.percentile("delivery", F.lit(0.5)).alias("median"))


def netlist_fanout(spark, d):
    """Orders as cells of a netlist that is written and read back: cells, area and driven pins by cell type, nets resolved through assigns and ports."""
    at, o = new_folder(spark, "netlist"), table(spark, d, "orders").select("o_orderkey", "o_custkey")
    k = F.col("o_orderkey")
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    near = F.when(k % 3 == 0, text("q", (F.floor(k / 20) * 10).cast("string"))).otherwise(text("\\n", F.floor(k / 2).cast("string"), " "))
    cell = text("t", (F.col("o_custkey") % 25).cast("string"), " u", k.cast("string"), " ( .A(", near, "), .B(1'b0), .X(n", k.cast("string"), ") );")
    names = F.when(k % 10 == 0, text("\nassign p", k.cast("string"), " = n", k.cast("string"), ";\nassign q", k.cast("string"), " = p", k.cast("string"), ";")).otherwise("")
    port = F.when(k % 100 == 0, text("\noutput q", k.cast("string"), ";")).otherwise("")
    o.select(text(cell, names, port).alias("value")).write.text(f"{at}/netlist")
    n = table(spark, d, "nation").select(text("cell (t", F.col("n_nationkey").cast("string"), ") { area : ", (1.5 + F.col("n_nationkey") * 0.25).cast("string"), "; pin (A) { direction : input; } pin (B) { direction : input; } pin (X) { direction : output; } }").alias("value"))
    n.write.text(f"{at}/library")
    g = netlist.read_design(spark, f"{at}/netlist", netlist.read_liberty(spark, f"{at}/library"))
    cells = g.where("output AND cell IS NOT NULL").groupBy("cell").agg(F.count("*").alias("cells"), F.sum("area").alias("area"))
    driven = netlist.connections(g).groupBy("cell").agg(F.count("*").alias("pins"), F.count_if(F.col("to_cell").isNull()).alias("ports"))
    return cells.join(driven, "cell", "left").select("cell", "cells", F.round("area", 6).alias("area"), F.coalesce("pins", F.lit(0)).alias("pins"), F.coalesce("ports", F.lit(0)).alias("ports"))


QUERIES = {
    "sequence_unwrap": (sequence_unwrap, f"""{R}, g AS (SELECT user_id, event_id, k, (((seq - coalesce(lag(seq) OVER (PARTITION BY user_id ORDER BY event_id), -1)) % 64) + 64) % 64 AS step FROM r WHERE NOT lost)
        SELECT user_id, count(*) AS got, sum(step - 1)::BIGINT AS missing, sum((n != k)::BIGINT)::BIGINT AS wrong FROM (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM g) GROUP BY user_id"""),
    "lost_packets": (lost_packets, f"{R} SELECT user_id, k FROM r WHERE lost"),
    "expected_vs_received": (expected_vs_received, f"""{R} SELECT CASE WHEN a.k IS NULL THEN 'unexpected' WHEN b.k IS NULL THEN 'lost' ELSE 'matched' END AS kind, count(*) AS n
        FROM (SELECT * FROM r WHERE event_type != 'click') a FULL JOIN (SELECT * FROM r WHERE NOT lost) b ON a.user_id = b.user_id AND a.k = b.k GROUP BY 1"""),
    "packet_split": (packet_split, f"""{R}, t AS (SELECT *, CASE WHEN event_type = 'purchase' THEN 'complete' WHEN event_id % 37 = 0 THEN 'aborted' END AS e FROM r),
        p AS (SELECT *, coalesce(sum((e IS NOT NULL)::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pkt FROM t),
        q AS (SELECT user_id, pkt, count(*) AS n, coalesce(max(e), 'eof') AS status FROM p GROUP BY ALL) SELECT status, count(*) AS packets, sum(n)::BIGINT AS tokens FROM q GROUP BY 1"""),
    "segments": (segments, f"""{R}, t AS (SELECT *, value > 100 AS on_, (value > 100 AND NOT coalesce(lag(value > 100) OVER (PARTITION BY user_id ORDER BY event_id), false))::BIGINT AS st FROM r),
        g AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY event_id) AS seg FROM t), s AS (SELECT user_id, seg, count(*) AS n, max((value > 480)::INT) AS o FROM g WHERE on_ GROUP BY ALL)
        SELECT user_id, count(*) AS segments, max(n) AS longest, sum(o)::BIGINT AS overflows FROM s GROUP BY user_id"""),
    "queue_latency": (queue_latency, f"""{R}, a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM r WHERE event_type IN ('click', 'view')),
        b AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM r WHERE event_type IN ('purchase', 'signup')), j AS (SELECT abs(b.event_id - a.event_id) AS lat FROM a JOIN b USING (user_id, n))
        SELECT count(*) AS n, median(lat) AS median, max(lat) AS most, quantile_cont(lat, 0.9) AS p90 FROM j"""),
    "bytes_histogram": (bytes_histogram, f"{R}, b AS (SELECT user_id, k // 4 AS f, sum(floor(value / 50))::BIGINT AS bytes FROM r GROUP BY ALL) SELECT bytes, count(*) AS frames FROM b GROUP BY bytes"),
    "coverage": (coverage, f"""WITH w(bin) AS (VALUES {', '.join(f"('{b}')" for b in BINS)}), h AS (SELECT CASE WHEN value > 489 THEN 'overflow' WHEN user_id % 10 < 7 THEN 'slots_' || (user_id % 10 + 1) ELSE 'wrap' END AS bin, count(*) AS n FROM events GROUP BY 1)
        SELECT w.bin, coalesce(n, 0) AS n, n IS NULL AS missing FROM w LEFT JOIN h USING (bin)"""),
    "coverage_missing": (coverage_missing, f"""SELECT bin FROM (VALUES {', '.join(f"('{b}')" for b in BINS)}) w(bin) WHERE bin NOT IN (SELECT CASE WHEN value > 489 THEN 'overflow' WHEN user_id % 10 < 7 THEN 'slots_' || (user_id % 10 + 1) ELSE 'wrap' END FROM events)"""),
    "linear_fit": (linear_fit, "SELECT l_linenumber, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem GROUP BY 1"),
    "power_by_class": (power_by_class, "SELECT p_brand AS class, round(sum(l_quantity), 2) AS power, count(*) AS n, round(sum(l_quantity) / sum(sum(l_quantity)) OVER (), 8) AS share FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1"),
    "majority_vote": (majority_vote, "WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) = 1"),
    "top_per_group": (top_per_group, "SELECT o_custkey, count(*) AS leaves FROM orders GROUP BY 1 ORDER BY leaves DESC, max(o_orderdate) DESC, o_custkey LIMIT 25"),
    "nulls_last_order": (nulls_last_order, "SELECT c_custkey, round(sum(o_totalprice), 2) AS uw FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1 ORDER BY sum(o_totalprice) ASC NULLS LAST, c_custkey LIMIT 20"),
    "break_even": (break_even, RICE_SQL.replace("SELECT pkt, ch, bits FROM r WHERE i = 127", ", p AS (SELECT pkt, sum(bits)::DOUBLE / 1024 AS bps FROM r WHERE i = 127 GROUP BY pkt) SELECT pkt, bps, round((10 - bps) * 5.0::DOUBLE - 13.35::DOUBLE, 6) AS net_nj, (10 - bps) * 5.0::DOUBLE - 13.35::DOUBLE > 0 AS pays, round((10 - bps) * 5.0::DOUBLE, 6) AS budget_nj FROM p")),
    "symbols_hit": (symbols_hit, f"{BASE}, {wavelet.SYMBOLS_SQL} SELECT ctx, count(DISTINCT sym) AS hit, 64 - count(DISTINCT sym) AS missing FROM sm GROUP BY ctx"),
    "symbols_missing": (symbols_missing, f"{BASE}, {wavelet.SYMBOLS_SQL} SELECT (i // 64)::INT AS ctx, (i % 64)::INT AS sym FROM range(256) t(i) EXCEPT SELECT ctx, sym FROM sm"),
    "candidates_of_all": (candidates_of_all, f"{BASE}, {wavelet.SYMBOLS_SQL} SELECT ctx, sym FROM sm GROUP BY ALL HAVING count(DISTINCT pkt) = (SELECT count(DISTINCT pkt) FROM sm)"),
    "budget_scores": (budget_scores, f"WITH {METRICS_SQL} SELECT run, name, status FROM sc"),
    "overall_scores": (overall_scores, f"WITH {METRICS_SQL} SELECT run, arg_max(status, list_position(['PASS','INFO','N/A','WARN','FAIL'], status)) AS overall FROM sc GROUP BY run"),
    "fanout_trees": (fanout_trees, f"""WITH RECURSIVE {EDGES}, x(root, node, depth) AS (SELECT 'r' || r_regionkey, 'r' || r_regionkey, 0 FROM region UNION SELECT root, dst, depth + 1 FROM x JOIN ed ON src = node)
        SELECT root, sum((node NOT IN (SELECT src FROM ed))::BIGINT)::BIGINT AS leaves, sum((node IN (SELECT src FROM ed))::BIGINT)::BIGINT AS buffers, max(depth)::INT AS depth FROM x WHERE depth > 0 GROUP BY root"""),
    "nearest_named": (nearest_named, f"""WITH RECURSIVE {EDGES}, x(root, node, depth) AS (SELECT 'c' || c_custkey, 'c' || c_custkey, 0 FROM customer UNION SELECT root, src, depth + 1 FROM x JOIN ed ON dst = node WHERE depth < 4)
        SELECT root, arg_min(node, (depth, node)) AS named, min(depth)::INT AS hops FROM x WHERE regexp_matches(node, '^n[0-9]*[02468]$') GROUP BY root"""),
    "unconnected": (unconnected, f"WITH {EDGES} SELECT 's' || s_suppkey AS cell FROM supplier WHERE 's' || s_suppkey NOT IN (SELECT src FROM ed)"),
    "cell_classes": (cell_classes, "SELECT CASE WHEN regexp_matches(p_type, 'BRASS$') THEN 'flop' WHEN regexp_matches(p_type, '^(STANDARD|SMALL)') THEN 'buffer' WHEN regexp_matches(p_type, 'COPPER|TIN') THEN 'gate' ELSE 'logic' END AS class, count(*) AS n, sum(p_size)::BIGINT AS area FROM part GROUP BY 1"),
    "switching_activity": (switching_activity, """WITH t AS (SELECT user_id AS net, event_id AS t, (value > 250)::INT AS v FROM events WHERE value >= 20), w AS (SELECT *, lag(v) OVER (PARTITION BY net ORDER BY t) AS was, lead(t) OVER (PARTITION BY net ORDER BY t) AS next FROM t)
        SELECT net, sum((was != v)::BIGINT)::BIGINT AS toggles, sum(CASE WHEN v = 1 THEN next - t END)::BIGINT AS high FROM w GROUP BY net"""),
    "sampled_activity": (sampled_activity, """WITH a AS (SELECT user_id AS net, event_id // 64 AS edge, arg_max((value > 250)::INT, event_id) AS v FROM events GROUP BY ALL), w AS (SELECT *, lag(v) OVER (PARTITION BY net ORDER BY edge) AS was FROM a)
        SELECT net, count(*) AS edges, sum((was != v)::BIGINT)::BIGINT AS toggles FROM w GROUP BY net"""),
    "slew_violations": (slew_violations, "SELECT l_returnflag AS corner, sum((l_discount > 0.08)::BIGINT)::BIGINT AS total, sum((l_discount > 0.08 AND s_nationkey < 5)::BIGINT)::BIGINT AS clock FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1"),
    "stuck_bits": (stuck_bits, "SELECT user_id, count(DISTINCT b) AS kinds, bit_and(b) AS always, bit_or(b) AS ever FROM (SELECT user_id, floor(value)::INT & 127 AS b FROM events) GROUP BY user_id"),
    "first_difference": (first_difference, f"""{R}, d AS (SELECT user_id, k, lost, (lost OR event_id % 53 = 0) AS differs FROM r) SELECT user_id, min(CASE WHEN differs THEN k END) AS first, sum(lost::BIGINT)::BIGINT AS short FROM d GROUP BY user_id"""),
    "sequence_fault": (sequence_fault, f"""{R}, c AS (SELECT user_id, seq, CASE WHEN user_id % 3 = 0 THEN xor(seq, 4) WHEN user_id % 3 = 1 THEN (seq + 5) % 64 ELSE seq END AS claim FROM r),
        x AS (SELECT user_id, count(DISTINCT xor(claim, seq)) AS xors, max(bit_count(xor(claim, seq))) AS bits, count(DISTINCT (claim - seq + 64) % 64) AS steps FROM c GROUP BY user_id)
        SELECT CASE WHEN xors = 1 AND bits = 0 THEN 'ok' WHEN xors = 1 AND bits = 1 THEN 'flipped bit' WHEN steps = 1 THEN 'offset' ELSE 'unclear' END AS kind, count(*) AS n FROM x GROUP BY 1"""),
    "stuck_hypotheses": (stuck_hypotheses, f"""WITH {SQL}, o AS (SELECT ch, code, CASE ch WHEN 2 THEN code | 8 WHEN 5 THEN code & 959 ELSE code END AS seen FROM s), h AS (SELECT (i % 10)::INT AS bit, i >= 10 AS high FROM range(20) t(i))
        SELECT ch, bit, high FROM o, h GROUP BY ALL HAVING bool_and(seen = CASE WHEN high THEN code | (1 << bit) ELSE code & (1023 - (1 << bit)) END)"""),
    "worst_verdict": (worst_verdict, """WITH e AS (SELECT *, CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 1 WHEN 'error' THEN 2 WHEN 'click' THEN 3 ELSE 9 END AS rk FROM events)
        SELECT user_id, event_type AS verdict, event_id AS packet FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rk, event_id) = 1"""),
    "labelled_blocks": (labelled_blocks, """WITH na AS (SELECT 'c' || c_custkey AS node, 'seg ' || c_mktsegment AS label FROM customer WHERE c_custkey % 97 = 0 UNION ALL SELECT 's' || s_suppkey, 'nation ' || s_nationkey FROM supplier WHERE s_suppkey % 7 = 0),
        o1 AS (SELECT o_orderkey, min(label) AS label FROM orders JOIN na ON node = 'c' || o_custkey GROUP BY o_orderkey), dn AS (SELECT l_partkey, min(label) AS label FROM lineitem JOIN o1 ON o_orderkey = l_orderkey GROUP BY l_partkey),
        up AS (SELECT l_partkey, min(label) AS label FROM lineitem JOIN na ON node = 's' || l_suppkey GROUP BY l_partkey),
        b AS (SELECT p_brand, coalesce(dn.label, up.label, 'core') AS label, CASE WHEN dn.label IS NOT NULL THEN 'down' WHEN up.label IS NOT NULL THEN 'up' ELSE 'none' END AS way FROM part LEFT JOIN dn ON dn.l_partkey = p_partkey LEFT JOIN up ON up.l_partkey = p_partkey),
        n AS (SELECT p_brand, label, count(*) AS votes FROM b GROUP BY ALL), m AS (SELECT p_brand, label, votes FROM n QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY votes DESC, label) = 1)
        SELECT p_brand AS "group", any_value(m.label) AS label, any_value(votes) AS votes, count(*) AS of, count(*) FILTER (way = 'down') AS down, count(*) FILTER (way = 'up') AS up, count(*) FILTER (way = 'none') AS none FROM b JOIN m USING (p_brand) GROUP BY p_brand"""),
    "delivery_latencies": (delivery_latencies, """WITH a AS (SELECT user_id, event_id AS pushed, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type IN ('click', 'view')),
        b AS (SELECT user_id, event_id AS coded, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 2 AS n FROM events WHERE event_type IN ('purchase', 'error')), j AS (SELECT user_id, pushed, coded FROM a JOIN b USING (user_id, n)),
        k AS (SELECT j.user_id, pushed, coded, (SELECT min(event_id) FROM events e WHERE e.event_type = 'signup' AND e.user_id = j.user_id AND e.event_id >= coded) AS ended FROM j)
        SELECT user_id, count(*) AS samples, sum(coded - pushed)::BIGINT AS processing, max(coded - pushed) AS most, count(ended) AS delivered, sum(ended - pushed)::BIGINT AS delivery, quantile_cont(ended - pushed, 0.5) AS median FROM k GROUP BY user_id"""),
    "netlist_fanout": (netlist_fanout, """WITH c AS (SELECT o_orderkey AS k, 't' || o_custkey % 25 AS cell, 1.5 + (o_custkey % 25) * 0.25 AS area, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey // 20 * 10 ELSE o_orderkey // 2 END AS net FROM orders),
        s AS (SELECT net, false AS port FROM c UNION ALL SELECT k, true FROM c WHERE k % 100 = 0), d AS (SELECT cell, count(*) AS pins, count(*) FILTER (port) AS ports FROM c x JOIN s ON s.net = x.k GROUP BY cell)
        SELECT cell, count(*) AS cells, round(sum(area)::DOUBLE, 6) AS area, coalesce(any_value(pins), 0) AS pins, coalesce(any_value(ports), 0) AS ports FROM c LEFT JOIN d USING (cell) GROUP BY cell"""),
}
