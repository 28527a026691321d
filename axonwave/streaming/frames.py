"""The frame policy in a stream: one open frame and packet for each stream, closed by tokens or by a timer.

A frame that does not fill up and is not followed by another has only its time limit: an event-time timer closes it when the
watermark has passed, so its packet comes out although its stream is silent. The same rows as `operators.frames.frame_packets`; what is
open when the input ends stays open. State is bounded: the last code of each place, and sums.

Streams are dealt to groups by hash, and a group's streams share a state (an array for each variable) and a timer, the first limit among them: a call for a key and
each of its trips to the state cost milliseconds, a token microseconds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from axonwave.operators.frames import PACKETS, FramePolicy

STATE = ", ".join(f"{c} array<{t}>" for c, t in (c.split() for c in "stream long, seg long, on boolean, over boolean, frame long, begun long, place int, frames int, short int, lost boolean, total long, codes long".split(", ")))


@dataclass
class Open:
    """What a stream has open. begun: the open frame's first clock, -1 if none is open; frames, short, lost and total are of the open packet."""

    seg: int = 0
    on: bool = False
    over: bool = False
    frame: int = -1  #: of the segment, the last one begun
    begun: int = -1
    place: int = 0
    frames: int = 0
    short: int = 0
    lost: bool = False
    total: int = 0
    codes: list[int] = field(default_factory=list)

    def row(self) -> tuple:
        return (self.seg, self.on, self.over, self.frame, self.begun, self.place, self.frames, self.short, self.lost, self.total, list(self.codes))


class _Frames(StatefulProcessor):
    def __init__(self, cfg: FramePolicy, tick_ms: int):
        self.cfg, self.tick_ms = cfg, tick_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("open", STATE)

    def _packet(self, s: Open, whole: bool):
        """The open packet's row; the next packet begins."""
        lost = s.lost or (s.short > 0 and self.cfg.on_short == "abort")
        status, pkt = "aborted" if lost else "complete" if whole else "eof", s.frame // self.cfg.frames_per_packet
        out = (s.seg, pkt, pkt % 64, status, s.frames, s.short, s.over, s.total if status == "complete" else None)
        s.frames, s.short, s.lost, s.total = 0, 0, False, 0
        return out

    def _close(self, s: Open):
        """Closes the open frame; its packet's row, if it was the last one of it."""
        missing = range(s.place, self.cfg.n_slots)
        s.short += bool(missing)
        if self.cfg.on_short == "repair":
            s.total += sum(s.codes[k] for k in missing)
        s.frames, s.begun = s.frames + 1, -1
        return self._packet(s, True) if (s.frame + 1) % self.cfg.frames_per_packet == 0 else None

    def _token(self, s: Open, clock: int, kind: str, start: bool, code: int):
        if s.begun >= 0 and clock >= s.begun + self.cfg.limit:
            yield self._close(s)
        if kind == "enable" and not s.on:
            s.__dict__.update(Open(seg=s.seg + 1, on=True, codes=[self.cfg.idle] * self.cfg.n_slots).__dict__)
        elif kind == "disable" and s.on:
            if s.begun >= 0 or s.frames:
                yield self._packet(s, False)
            s.__dict__.update(Open(seg=s.seg).__dict__)
        elif not s.on:
            return
        elif kind == "overflow":
            s.over = True
        elif kind == "abort":
            s.lost |= s.begun >= 0 or s.frames > 0  # between packets there is none to abort
        elif kind == "slot":
            if start:
                if s.begun >= 0:
                    yield self._close(s)
                s.frame, s.begun, s.place = s.frame + 1, clock, 0
            if s.begun >= 0:
                s.codes[s.place] = code
                s.total, s.place = s.total + code, s.place + 1
                if s.place == self.cfg.n_slots:
                    yield self._close(s)

    def _load(self) -> dict[int | None, Open]:
        held = self.state.get()
        if held is None:
            return {}
        *columns, codes = (list(c) for c in held)
        n = self.cfg.n_slots
        return {stream: Open(*row, codes=codes[k * n : k * n + n]) for k, (stream, *row) in enumerate(zip(*columns, strict=True))}

    def _save(self, of: dict[int | None, Open]) -> None:
        rows = [(stream, *s.row()) for stream, s in of.items()]
        *columns, codes = zip(*rows, strict=True)
        self.state.update((*map(list, columns), [v for c in codes for v in (c or [self.cfg.idle] * self.cfg.n_slots)]))

    def _due(self, of: dict[int | None, Open]) -> int | None:
        """The first limit of an open frame; it is the only timer of a group, so the state tells which one is set."""
        return min(((s.begun + self.cfg.limit) * self.tick_ms for s in of.values() if s.begun >= 0), default=None)

    def _packets(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PACKETS.split(", ")]).astype({"stream": "Int64", "total": "Int64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        of = self._load()
        out, was, tokens = [], self._due(of), []
        for pdf in rows:
            streams = pdf.stream.tolist() if key[0] >= 0 else [None] * len(pdf)
            tokens += zip(pdf.clock.tolist(), streams, pdf.kind.tolist(), pdf.start.tolist(), pdf.code.tolist(), strict=True)
        for clock, stream, *r in sorted(tokens, key=lambda t: t[0]):
            if stream not in of:
                of[stream] = Open()
            out += [(stream, *p) for p in self._token(of[stream], clock, *r) if p]
        self._save(of)
        due = self._due(of)
        if was not in (None, due):
            self.handle.deleteTimer(was)
        if due not in (None, was):
            self.handle.registerTimer(due)
        yield from self._packets(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Closes every frame of the group whose limit the watermark has passed; what comes later is later than that."""
        of, out = self._load(), []
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        for stream, s in of.items():
            if s.begun >= 0 and (s.begun + self.cfg.limit) * self.tick_ms <= now and (p := self._close(s)):
                out.append((stream, *p))
        self._save(of)
        if (due := self._due(of)) is not None:
            self.handle.registerTimer(due)
        yield from self._packets(out)

    def close(self) -> None:
        pass


def streaming_frame_packets(tokens: DataFrame, cfg: FramePolicy = FramePolicy(), tick_ms: int = 1, late: str = "0 seconds", groups: int = 1024) -> DataFrame:
    """Streamed tokens (stream, clock, kind, start, code) -> PACKETS. Event time is the clock; tokens more than late behind the latest are dropped.

    groups: how many groups share the streams; it belongs to the checkpoint.
    """
    t = tokens.select("stream", "clock", "kind", F.coalesce("start", F.lit(False)).alias("start"), F.coalesce("code", F.lit(0)).cast("long").alias("code"))
    t = t.withColumn("ts", F.timestamp_millis(F.col("clock") * tick_ms)).withWatermark("ts", late)
    group = F.when(F.col("stream").isNull(), -1).otherwise(F.pmod(F.xxhash64("stream"), F.lit(groups))).cast("int")
    return t.withColumn("group", group).groupBy("group").transformWithStateInPandas(_Frames(cfg, tick_ms), PACKETS, "Append", "EventTime")
