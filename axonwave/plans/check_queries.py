"""Queries of stream checks and verdicts: every user's events as a capture, with faults by user number, and customers as register readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from axonwave.operators.checks import RANK, readback, stream_findings, verdicts
from axonwave.plans.samples import table


def captures(spark, d):
    """(tokens, expected bytes, streams, registers). By user modulo 10: 0 has a stuck pin, 1 a stuck output, 2 none, 3 no packet ends; the others are as recorded."""
    e = table(spark, d, "events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("pos"), "event_type", F.floor("value").bitwiseAND(F.lit(255).cast("long")).alias("want"))
    u = F.col("stream") % 10
    kind = F.when((F.col("event_type") == "signup") & (F.col("pos") % 11 == 0), "A").when((F.col("event_type") == "error") & (F.col("pos") % 53 == 0), "O").otherwise("B")
    v = F.when(u == 0, F.col("want").bitwiseOR(F.lit(8).cast("long"))).when(u == 1, 64).otherwise(F.col("want"))
    t = e.where(u != 2).select("stream", "pos", kind.alias("kind"), v.alias("v"), ((kind == "B") & (F.col("event_type") == "purchase") & (u != 3)).alias("last"))
    c = table(spark, d, "customer").select((F.col("c_custkey") % 150).alias("stream"), F.floor(F.col("c_custkey") / 150).alias("addr"), F.col("c_nationkey").cast("long").alias("want"))
    got = F.when(F.col("stream") % 13 == 0, 255).when(F.col("stream") % 7 == 0, F.col("want").bitwiseXOR(F.lit(4).cast("long"))).otherwise(F.col("want"))
    return t, e.select("stream", F.col("want").alias("v")), e.select("stream").distinct(), c.withColumn("got", got)


def capture_findings(spark, d):
    t, want, streams, registers = captures(spark, d)
    return stream_findings(t, want, streams, least=32).unionByName(readback(registers))


def capture_verdicts(spark, d):
    return verdicts(capture_findings(spark, d))


_SQL = f"""WITH e AS (SELECT user_id AS stream, event_id AS pos, event_type, floor(value)::BIGINT & 255 AS want FROM events),
t0 AS (SELECT stream, pos, CASE WHEN event_type = 'signup' AND pos % 11 = 0 THEN 'A' WHEN event_type = 'error' AND pos % 53 = 0 THEN 'O' ELSE 'B' END AS kind, CASE stream % 10 WHEN 0 THEN want | 8 WHEN 1 THEN 64 ELSE want END AS v, event_type FROM e WHERE stream % 10 != 2),
t AS (SELECT stream, pos, kind, v, kind = 'B' AND event_type = 'purchase' AND stream % 10 != 3 AS last FROM t0),
o AS (SELECT stream, count(*) FILTER (kind = 'B') AS n, count(*) FILTER (kind = 'A') AS aborts, count(DISTINCT v) FILTER (kind = 'B') AS vals, min(v) FILTER (kind = 'B') AS v, bit_and(v) FILTER (kind = 'B') AS ones, bit_or(v) FILTER (kind = 'B') AS any_, count(*) FILTER (last) AS ends, max(pos) FILTER (last) AS fin FROM t GROUP BY stream),
m AS (SELECT stream, bit_or(want) & ~bit_and(want) AS moves FROM e GROUP BY stream),
p AS (SELECT *, coalesce(sum((last OR kind = 'A')::INT) OVER (PARTITION BY stream ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pkt FROM t WHERE kind != 'O'),
h AS (SELECT stream, pkt, arg_min(v, pos) FILTER (kind = 'B') AS head, count(*) FILTER (kind = 'A') AS aborted FROM p GROUP BY stream, pkt),
g AS (SELECT stream, pkt, ((head & 63) - lag(head & 63) OVER (PARTITION BY stream ORDER BY pkt) + 64) % 64 AS jump FROM h WHERE head IS NOT NULL),
c AS (SELECT c_custkey % 150 AS stream, c_nationkey::BIGINT AS want, CASE WHEN c_custkey % 150 % 13 = 0 THEN 255 WHEN c_custkey % 150 % 7 = 0 THEN xor(c_nationkey::BIGINT, 4) ELSE c_nationkey END AS got FROM customer),
r AS (SELECT stream, count(*) AS n, count(*) FILTER (got != want) AS bad, count(DISTINCT got) AS vals, bit_or(xor(got, want)) AS bits FROM c GROUP BY stream),
f AS (SELECT DISTINCT stream, 'no_output' AS kind, NULL::BIGINT AS packet, NULL::BIGINT AS data FROM e WHERE stream NOT IN (SELECT stream FROM o WHERE n + aborts > 0)
  UNION ALL SELECT stream, 'stuck_output', NULL, v FROM o WHERE vals = 1 AND n > 8 UNION ALL SELECT stream, 'no_last', NULL, NULL FROM o WHERE n > 0 AND ends = 0
  UNION ALL SELECT stream, 'pin_stuck', NULL, b FROM o JOIN m USING (stream), range(8) x(b) WHERE n >= 32 AND vals > 1 AND (((ones | ~any_) & moves) >> b) & 1 = 1
  UNION ALL SELECT stream, 'seq_gap', min(pkt), count(*) FROM g WHERE jump != 1 GROUP BY stream
  UNION ALL SELECT stream, 'trailing', NULL, count(*) FROM t JOIN o USING (stream) WHERE t.kind = 'B' AND t.pos > o.fin GROUP BY stream
  UNION ALL SELECT stream, 'abort', min(pkt), count(*) FROM h WHERE aborted > 0 GROUP BY stream
  UNION ALL SELECT stream, CASE WHEN bad = n AND vals = 1 AND n > 1 THEN 'readback_dead' ELSE 'readback_bits' END, NULL, CASE WHEN NOT (bad = n AND vals = 1 AND n > 1) THEN bits END FROM r WHERE bad > 0)"""

QUERIES = {
    "capture_findings": (capture_findings, f"{_SQL} SELECT stream, kind, packet, data FROM f"),
    "capture_verdicts": (capture_verdicts, f"""{_SQL}, k AS (SELECT *, list_position({RANK}, kind) AS rk FROM f)
        SELECT stream, kind, packet, data, of FROM (SELECT *, count(*) OVER (PARTITION BY stream) AS of, row_number() OVER (PARTITION BY stream ORDER BY rk, coalesce(packet, -1), coalesce(data, -1)) AS first FROM k) WHERE first = 1"""),
}
