"""The frame policy: hand cases, batch against a plain loop, and the stream against the batch over micro-batches, a restart and timers."""

import random
from collections import Counter

import pytest

from axonwave.operators.frames import FramePolicy, frame_packets
from axonwave.streaming import coder
from axonwave.streaming.frames import streaming_frame_packets

TOKENS = "stream long, clock long, kind string, start boolean, code long"


def _tokens(seed, stream, n):
    r, out, clock = random.Random(seed), [], 0
    for k in range(n):
        clock += r.choice([1, 1, 1, 2, 9])
        kind = "enable" if k == 3 else r.choices(["slot", "enable", "disable", "abort", "overflow"], [100, 3, 2, 2, 2])[0]
        slot = kind == "slot"
        out.append((stream, clock, kind, slot and r.random() < 0.28, r.randint(0, 1023) if slot else None))
    return out


def _plain(tokens, cfg, upto=None):
    """One token after the other, no state machine shared with the library: every frame is written down first, packets are made afterwards."""
    out = Counter()
    for stream in {t[0] for t in tokens}:
        segs, on = [], False
        for _, clock, kind, start, code in sorted(t for t in tokens if t[0] == stream):
            if kind == "enable" and not on:
                on = True
                segs.append({"tokens": [], "end": None})
            elif kind == "disable" and on:
                on, segs[-1]["end"] = False, clock
            elif on:
                segs[-1]["tokens"].append((clock, kind, start, code))
        for k, seg in enumerate(segs, 1):
            starts = [c for c, kind, start, _ in seg["tokens"] if kind == "slot" and start]
            frames, last = [], [cfg.idle] * cfg.n_slots
            for i, a in enumerate(starts):
                b = starts[i + 1] if i + 1 < len(starts) else float("inf")
                have = [(c, v) for c, kind, _, v in seg["tokens"] if kind == "slot" and a <= c < min(b, a + cfg.limit)][: cfg.n_slots]
                end = have[-1][0] if len(have) == cfg.n_slots else min(b, a + cfg.limit)
                stop = seg["end"] if seg["end"] is not None else float("inf")
                if len(have) < cfg.n_slots and (stop < end or (b == stop == float("inf") and not (upto is not None and end <= upto))):
                    frames.append(None)  # still open, or cut by the end
                    continue
                last[: len(have)] = [v for _, v in have]
                frames.append((end, len(have) < cfg.n_slots, sum(last) if cfg.on_short == "repair" else sum(v for _, v in have)))
            for p in range(-(-len(frames) // cfg.frames_per_packet)):
                own = frames[p * cfg.frames_per_packet : (p + 1) * cfg.frames_per_packet]
                done = [f for f in own if f]
                whole = len(done) == cfg.frames_per_packet
                if not whole and seg["end"] is None:
                    continue
                end, short = done[-1][0] if whole else seg["end"], sum(f[1] for f in done)
                begin = starts[p * cfg.frames_per_packet]
                lost = any(kind == "abort" and begin < c < end for c, kind, _, _ in seg["tokens"]) or short and cfg.on_short == "abort"
                status = "aborted" if lost else "complete" if whole else "eof"
                over = any(kind == "overflow" and c < end for c, kind, _, _ in seg["tokens"])
                out[stream, k, p, p % 64, status, len(done), short, over, sum(f[2] for f in done) if status == "complete" else None] += 1
    return out


def _rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_hand_cases(spark):
    slot = lambda c, v, start=False: (1, c, "slot", start, v)
    t = [slot(1, 5, True), (1, 2, "enable", False, None), slot(3, 7), slot(4, 10, True), slot(5, 11), slot(6, 99), slot(7, 20, True), slot(8, 30, True), slot(9, 31), (1, 10, "abort", False, None), slot(11, 40, True), slot(12, 41), (1, 13, "overflow", False, None), slot(14, 50, True), slot(40, 51), slot(41, 60, True), (1, 42, "disable", False, None), slot(43, 1, True)]
    df = spark.createDataFrame(t, TOKENS)
    repair = FramePolicy(n_slots=2, frames_per_packet=2, limit=20, on_short="repair")
    # packet 0: 10 11, then 20 with 11 repeated; 1: abort after its first frame; 2: 50 comes alone (51 is too late) and overflow is known; 60 is cut
    want = {(1, 1, 0, 0, "complete", 2, 1, False, 10 + 11 + 20 + 11): 1, (1, 1, 1, 1, "aborted", 2, 0, False, None): 1, (1, 1, 2, 2, "eof", 1, 1, True, None): 1}
    assert _plain(t, repair) == want == _rows(frame_packets(df, repair))
    abort = FramePolicy(n_slots=2, frames_per_packet=2, limit=20, on_short="abort")
    assert {r.pkt: r.status for r in frame_packets(df, abort).collect()} == {0: "aborted", 1: "aborted", 2: "aborted"}
    with pytest.raises(ValueError):
        FramePolicy(on_short="pad")


@pytest.mark.parametrize("on_short", ["repair", "abort"])
def test_batch_is_the_plain_loop(spark, on_short):
    t = [x for s in range(12) for x in _tokens(s, s, 400)]
    for n, per, limit in ((3, 2, 12), (4, 3, 1000), (1, 1, 1)):
        cfg = FramePolicy(n, per, limit, on_short)
        for upto in (None, 10_000):
            want = _plain(t, cfg, upto)
            assert _rows(frame_packets(spark.createDataFrame(t, TOKENS), cfg, upto)) == want and len(want) > 50
    assert frame_packets(spark.createDataFrame([], TOKENS)).count() == 0


@pytest.mark.parametrize("on_short", ["repair", "abort"])
def test_stream_is_the_batch(spark, tmp_path, on_short):
    """Cut at clocks into files, read by two runs; silent streams are closed by timers."""
    cfg = FramePolicy(3, 2, 12, on_short)
    t = [x for s in range(6) for x in _tokens(s + 50, s, 60 + 50 * s)]  # streams fall silent one after the other
    top = max(x[1] for x in t)
    src, schema = str(tmp_path / "in"), TOKENS
    cuts = [0, 100, 101, top // 2, top + 1]
    for k in range(4):
        own = [x for x in t if cuts[k] <= x[1] < cuts[k + 1]]
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(src)
        if k in (1, 3):
            with coder.state_store(spark):
                made = streaming_frame_packets(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), cfg)
                made.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got = _rows(spark.read.parquet(f"{tmp_path}/out"))
    assert got == _plain(t, cfg, top) and got != _plain(t, cfg)  # timers have closed frames that no token closes


def test_streams_share_the_state_of_their_group(spark, tmp_path):
    """One state row and one timer at a time for all streams of a group, over two runs; the rows are those of streams on their own."""
    cfg = FramePolicy(3, 2, 12, "repair")
    t = [x for s in range(20) for x in _tokens(s + 80, s, 40 + 9 * s)]
    top, src = max(x[1] for x in t), str(tmp_path / "in")
    for k, own in enumerate(([x for x in t if x[1] < top // 2], [x for x in t if x[1] >= top // 2])):
        spark.createDataFrame(own, TOKENS).write.mode("append").parquet(src)
        with coder.state_store(spark):
            made = streaming_frame_packets(spark.readStream.schema(TOKENS).parquet(src), cfg, groups=2)
            q = made.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
            q.awaitTermination()
        assert max(p.stateOperators[0].numRowsTotal for p in q.recentProgress) <= 8  # two states, two timers and their index
    assert _rows(spark.read.parquet(f"{tmp_path}/out")) == _plain(t, cfg, top)
