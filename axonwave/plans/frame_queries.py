"""Queries of the frame policy: malformed frames, aborts, overflows and enable periods over the event table as a slot stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from axonwave.operators.frames import FramePolicy, frame_packets
from axonwave.plans.samples import table
from axonwave.sources.folders import new_folder
from axonwave.streaming import coder
from axonwave.streaming.frames import streaming_frame_packets

SLOTS, FRAMES, LIMIT = 3, 2, 600
# what a signup event stands for, by event_id modulo 5
CONTROL = ["disable", "enable", "abort", "overflow", "enable"]


def tokens(spark, d):
    """Every user is a slot stream and event ids are its clock: signups are control tokens, clicks begin frames, all others are slots."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    control = F.element_at(F.array(*[F.lit(c) for c in CONTROL]), (F.pmod("event_id", F.lit(5)) + 1).cast("int"))
    kind = F.when(F.col("event_type") == "signup", control).otherwise("slot")
    code = F.least(F.lit(1023), F.greatest(F.lit(0), F.bround("value", 0).cast("long")))
    return e.select(F.col("user_id").alias("stream"), F.col("event_id").alias("clock"), kind.alias("kind"), (F.col("event_type") == "click").alias("start"), code.alias("code"))


def _reached(t):
    return t.agg(F.max("clock")).first()[0]


def frames_repaired(spark, d):
    t = tokens(spark, d)
    return frame_packets(t, FramePolicy(SLOTS, FRAMES, LIMIT, "repair"), _reached(t))


def frames_aborted(spark, d):
    t = tokens(spark, d)
    return frame_packets(t, FramePolicy(SLOTS, FRAMES, LIMIT, "abort"), _reached(t))


def streamed_frames(spark, d):
    """The same from a stream in two runs; what no token closes is closed by event-time timers."""
    t, at = tokens(spark, d), new_folder(spark, "streamed-frames")
    top = _reached(t) or 0
    with coder.state_store(spark):
        for part in (F.col("clock") < top // 2, F.col("clock") >= top // 2):
            t.where(part).write.mode("append").parquet(f"{at}/in")
            made = streaming_frame_packets(spark.readStream.schema(t.schema).parquet(f"{at}/in"), FramePolicy(SLOTS, FRAMES, LIMIT, "repair"))
            made.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{at}/out")


def _sql(repair: bool) -> str:
    filled = f"""gr AS (SELECT stream, seg, frame, unnest(range({SLOTS})) AS place FROM f WHERE closed),
    fi AS (SELECT gr.stream, gr.seg, gr.frame, coalesce(last_value(k.code IGNORE NULLS) OVER (PARTITION BY gr.stream, gr.seg, gr.place ORDER BY gr.frame), 512) AS code FROM gr LEFT JOIN k USING (stream, seg, frame, place)),
    ft AS (SELECT stream, seg, frame, sum(code) AS total FROM fi GROUP BY ALL)""" if repair else "ft AS (SELECT stream, seg, frame, total FROM f)"  # fmt: skip
    short = "false" if repair else "short > 0"
    return f"""WITH tk AS (SELECT user_id AS stream, event_id AS clock, CASE WHEN event_type = 'signup' THEN {CONTROL}[event_id % 5 + 1] ELSE 'slot' END AS kind, event_type = 'click' AS start, least(1023, greatest(0, round_even(value, 0)::BIGINT)) AS code FROM events),
    o AS (SELECT *, coalesce(last_value(CASE WHEN kind IN ('enable', 'disable') THEN kind END IGNORE NULLS) OVER (PARTITION BY stream ORDER BY clock) = 'enable', false) AS up FROM tk),
    b AS (SELECT *, up AND NOT coalesce(lag(up) OVER (PARTITION BY stream ORDER BY clock), false) AS begins FROM o),
    g AS (SELECT *, sum(begins::INT) OVER (PARTITION BY stream ORDER BY clock) AS seg FROM b),
    e AS (SELECT *, min(CASE WHEN NOT up THEN clock END) OVER (PARTITION BY stream, seg) AS seg_end FROM g WHERE seg > 0),
    t AS (SELECT *, sum((kind = 'slot' AND start)::INT) OVER (PARTITION BY stream, seg ORDER BY clock) - 1 AS frame FROM e WHERE up),
    sl AS (SELECT *, row_number() OVER (PARTITION BY stream, seg, frame ORDER BY clock) - 1 AS place, min(clock) OVER (PARTITION BY stream, seg, frame) AS since FROM t WHERE kind = 'slot' AND frame >= 0),
    k AS (SELECT * FROM sl WHERE place < {SLOTS} AND clock < since + {LIMIT}),
    f0 AS (SELECT stream, seg, frame, min(since) AS since, count(*) AS n, max(clock) AS last, sum(code) AS total, any_value(seg_end) AS seg_end FROM k GROUP BY stream, seg, frame),
    f1 AS (SELECT *, least(coalesce(lead(since) OVER (PARTITION BY stream, seg ORDER BY frame), since + {LIMIT}), since + {LIMIT}) AS until, lead(since) OVER (PARTITION BY stream, seg ORDER BY frame) IS NOT NULL AS followed FROM f0),
    f AS (SELECT *, n = {SLOTS} OR (NOT coalesce(seg_end < until, false) AND (followed OR seg_end IS NOT NULL OR since + {LIMIT} <= (SELECT max(event_id) FROM events))) AS closed, CASE WHEN n = {SLOTS} THEN last ELSE until END AS fin FROM f1), {filled},
    p0 AS (SELECT f.stream, f.seg, f.frame // {FRAMES} AS pkt, count(*) FILTER (closed) AS frames, count(*) FILTER (closed AND n < {SLOTS}) AS short, max(fin) AS fin, any_value(seg_end) AS seg_end, sum(ft.total) FILTER (closed) AS total
        FROM f LEFT JOIN ft USING (stream, seg, frame) GROUP BY ALL),
    p1 AS (SELECT *, CASE WHEN frames = {FRAMES} THEN fin ELSE seg_end END AS done FROM p0 WHERE frames = {FRAMES} OR seg_end IS NOT NULL),
    ab AS (SELECT stream, seg, frame // {FRAMES} AS pkt, min(clock) AS abort FROM t WHERE kind = 'abort' AND frame >= 0 GROUP BY ALL), ov AS (SELECT stream, seg, min(clock) AS over_ FROM t WHERE kind = 'overflow' GROUP BY ALL),
    p AS (SELECT p1.*, coalesce(over_ < done, false) AS overflow, CASE WHEN coalesce(abort < done, false) OR {short} THEN 'aborted' WHEN frames = {FRAMES} THEN 'complete' ELSE 'eof' END AS status
        FROM p1 LEFT JOIN ab USING (stream, seg, pkt) LEFT JOIN ov USING (stream, seg))
    SELECT stream, seg::BIGINT AS seg, pkt::BIGINT AS pkt, (pkt % 64)::INT AS seq, status, frames::INT AS frames, short::INT AS short, overflow, CASE WHEN status = 'complete' THEN total::BIGINT END AS total FROM p"""


QUERIES = {
    "frames_repaired": (frames_repaired, _sql(True)),
    "frames_aborted": (frames_aborted, _sql(False)),
    "streamed_frames": (streamed_frames, _sql(True)),
}
