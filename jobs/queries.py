"""The jobs as queries: each runs twice into one new folder below the shared one and gives the output as it stands after the second run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonwave.plans.packet_sql import rice_hex
from axonwave.sources.folders import new_folder
from jobs import packet_intake, rate_survey


def job1_packet_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = new_folder(spark, "packet-intake")
    for _ in range(2):
        out = packet_intake.run(spark, f"{sf_dir}/events.parquet", f"{at}/out", f"{at}/checkpoint")
    return out.withColumn("packet", F.hex("packet"))


def job2_rate_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = new_folder(spark, "rate-survey")
    for _ in range(2):
        out = rate_survey.run(spark, f"{sf_dir}/documents.parquet", at)
    return out


JOB1_SQL = f"""WITH RECURSIVE g AS (SELECT user_id AS stream, event_id, min({{'day': coalesce(strftime(ts, '%Y-%m-%d'), 'none'), 'code': least(1023, greatest(0, round_even(value, 0)::BIGINT))}}) AS o
    FROM events WHERE event_id IS NOT NULL AND user_id IS NOT NULL AND value IS NOT NULL AND NOT isnan(value) GROUP BY user_id, event_id),
f AS (SELECT stream, event_id, o.day AS day, o.code AS code, row_number() OVER (PARTITION BY stream ORDER BY event_id) - 1 AS frame, count(*) OVER (PARTITION BY stream) AS n FROM g),
q AS (SELECT stream, event_id, day, frame, frame // 32 AS pkt, 0 AS ch, frame % 32 AS i, code FROM f WHERE frame // 32 < n // 32), {rice_hex("q", "stream")}
SELECT stream, pkt, (pkt % 64)::INT AS seq, count(*)::INT AS n_samples, min(event_id) AS first_event_id, max(event_id) AS last_event_id, any_value(packet) AS packet, arg_max(day, frame) AS day
FROM q JOIN rice_hex USING (stream, pkt) GROUP BY stream, pkt"""

JOB2_SQL = f"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, lang, source, CASE WHEN ((coalesce(doc_id, 0) % 65536 + 65536) % 65536 * 40503) % 65536 < 32768 THEN 0 ELSE 1 END AS fold, hex(encode(coalesce(text, ''))) AS h FROM documents),
x AS (SELECT id, source, fold, i, (instr('0123456789ABCDEF', substr(h, (2 * i + 1)::INT, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(h, (2 * i + 2)::INT, 1)) - 1 AS v FROM (SELECT id, source, fold, h, unnest(range(length(h) // 2)) AS i FROM d)),
e AS (SELECT id, (v - lag(v) OVER (PARTITION BY id ORDER BY i) + 384) % 256 - 128 AS e FROM x),
m AS (SELECT id, CASE WHEN e >= 0 THEN 2 * e ELSE -2 * e - 1 END AS m, count(*) AS n FROM e WHERE e IS NOT NULL GROUP BY ALL),
k AS (SELECT id, k, sum(n * CASE WHEN (m >> k) < 16 THEN (m >> k) + 1 + k ELSE 24 END) AS bits FROM m, range(9) r(k) GROUP BY id, k),
best AS (SELECT id, arg_min(k, bits * 16 + k) AS k, min(bits) AS bits FROM k GROUP BY id),
n AS (SELECT id, source, fold, v, count(*) AS n FROM x GROUP BY ALL),
s AS (SELECT source, 1 - fold AS fold, v, sum(n) AS n FROM n GROUP BY ALL), t AS (SELECT source, fold, sum(n) AS total FROM s GROUP BY ALL),
c AS (SELECT n.id, sum(n.n * coalesce(round_even(-1000 * log2((coalesce(s.n, 0) + 0.5) / (t.total + 128)), 0)::BIGINT, 8000))::BIGINT AS millibits FROM n
    LEFT JOIN t ON n.source IS NOT DISTINCT FROM t.source AND n.fold = t.fold LEFT JOIN s ON n.source IS NOT DISTINCT FROM s.source AND n.fold = s.fold AND n.v = s.v GROUP BY n.id),
o AS (SELECT doc_id, lang, source, length(h) // 2 AS n_bytes, coalesce(best.k, 0)::INT AS rice_k, (coalesce(best.bits, 0) + CASE WHEN h = '' THEN 0 ELSE 8 END)::BIGINT AS rice_bits, coalesce(millibits, 0) AS table_millibits
    FROM d LEFT JOIN best USING (id) LEFT JOIN c USING (id)),
b AS (SELECT *, 8 * n_bytes AS raw, ceil(table_millibits / 1000)::BIGINT AS tb FROM o)
SELECT doc_id, lang, source, n_bytes, rice_k, rice_bits, table_millibits, CASE WHEN raw <= rice_bits AND raw <= tb THEN 'raw' WHEN rice_bits <= tb THEN 'rice' ELSE 'table' END AS best,
    least(raw, rice_bits, tb) AS best_bits, n_bytes >= 1 AND least(raw, rice_bits, tb) > 4.25::DOUBLE * n_bytes AS over_budget FROM b"""

QUERIES = {"job1_packet_intake": (job1_packet_intake, JOB1_SQL), "job2_rate_survey": (job2_rate_survey, JOB2_SQL)}
