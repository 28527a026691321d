"""Packet coders with state in a stream: what a packet resets and what outlives it are state variables of their own.

The Rice coder is kept for each (stream, channel): a value (next frame, sum, count, last code), which begins anew with
every packet, and a list, the codewords of the open packet. The adaptive coder is kept for each stream: a list, the symbols of the open packet, and a value that
outlives packets, the counts behind the next one's table. Packets come out when they are complete, as the batch codecs
make them, however samples were cut into micro-batches.

Rows of a key must come in order of micro-batches; within one they are sorted. A micro-batch is bounded by its source
(maxFilesPerTrigger), so a key's rows of one micro-batch fit a task; keys are streams, or streams and channels. State is in RocksDB
(`state_store`), and a lost executor's state is read again from the checkpoint.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from axonwave.functions import coding
from axonwave.functions.coding import BitString, RiceConfig
from axonwave.operators.codecs import PACKETS


PIECE = 64  #: packets of a channel that are put out together


@contextlib.contextmanager
def state_store(spark: SparkSession):
    """The session setting that named state needs, for streams started inside; then as it was."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class _Rice(StatefulProcessor):
    def __init__(self, cfg: RiceConfig):
        self.cfg = cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.coder = handle.getValueState("coder", "next long, total long, count long, last long")
        self.open = handle.getListState("open", "word long, bits int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        cfg = self.cfg
        # of a micro-batch only two numbers a sample are held; codewords leave a few packets at a time
        frames, codes = (np.concatenate(c) for c in zip(*((pdf.frame.to_numpy(np.int64), pdf.code.to_numpy(np.int32)) for pdf in rows), strict=True))
        order = np.argsort(frames, kind="stable")
        at, total, count, last = self.coder.get() if self.coder.exists() else (0, cfg.a_init, 1, 0)
        held = [tuple(w) for w in self.open.get()] if at % cfg.frames else []
        for begin in range(0, len(order), step := PIECE * cfg.frames):
            own, out = order[begin : begin + step], []
            for frame, x in zip(frames[own].tolist(), codes[own].tolist(), strict=True):
                if frame != at:
                    raise ValueError(f"stream {key[0]}, channel {key[1]}: frame {frame} in place of {at}")
                (ones, closed, value, bits), total, count = coding.rice_word(x, last if at % cfg.frames else None, total, count, cfg)
                held.append((((1 << ones) - 1 << closed) << bits | value, ones + closed + bits))
                at, last = at + 1, x
                if at % cfg.frames == 0:
                    words, sizes = zip(*held, strict=True)
                    out.append((key[0], key[1], at // cfg.frames - 1, list(words), list(sizes)))
                    held = []
            if out:
                yield pd.DataFrame(out, columns=["stream", "ch", "pkt", "words", "bits"])
        self.coder.update((at, total, count, last))
        self.open.put(held) if held else self.open.clear()

    def close(self) -> None:
        pass


def streaming_rice(x: DataFrame, cfg: RiceConfig = RiceConfig()) -> DataFrame:
    """Samples -> stream, ch, pkt, words, bits: the codewords of a channel in each packet that has become complete. Frames of a channel count from 0."""
    schema = "stream long, ch int, pkt long, words array<long>, bits array<int>"
    return x.select("stream", "ch", "frame", "code").groupBy("stream", "ch").transformWithStateInPandas(_Rice(cfg), schema, "Append", "None")


def lossless_packets(parts: DataFrame, n_ch: int) -> DataFrame:
    """The output of streaming_rice, all channels of a packet -> packets: channels take turns, codeword by codeword. Packets with fewer channels wait."""

    def merged(pkt: pd.Series, words: pd.Series, bits: pd.Series) -> pd.Series:
        out = []
        for k, of, sizes in zip(pkt, words, bits, strict=True):
            b = BitString()
            b.put(coding.header(0, int(k)), 8)
            for row in zip(*(zip(w, n, strict=True) for w, n in zip(of, sizes, strict=True)), strict=True):
                for w, n in row:
                    b.put(int(w), int(n))
            out.append(b.to_bytes())
        return pd.Series(out)

    each = parts.groupBy("stream", "pkt").agg(F.array_sort(F.collect_list(F.struct("ch", "words", "bits"))).alias("of")).where(F.size("of") == n_ch)
    made = F.pandas_udf(merged, "binary")("pkt", F.col("of.words"), F.col("of.bits"))
    names = [c.split()[0] for c in PACKETS.split(", ")]
    return each.select("stream", "pkt", F.lit(0).alias("mode"), F.pmod("pkt", F.lit(64)).cast("int").alias("seq"), made.alias("bytes")).select(*names)


class _Adaptive(StatefulProcessor):
    def __init__(self, n_ch: int, size: int, reset_every: int | None, n_sym: int, cap: int, lsh: int):
        self.n_ch, self.size, self.reset_every, self.n_sym, self.cap, self.lsh = n_ch, size, reset_every, n_sym, cap, lsh

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.table = handle.getValueState("table", "pkt long, counts array<long>")
        self.open = handle.getListState("open", "pkt long, pos long, ch int, sym long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))[["pkt", "pos", "ch", "sym"]]
        held = [tuple(r) for r in self.open.get()] + [tuple(int(v) for v in r) for r in new.itertuples(index=False)]
        held.sort()
        before, counts = self.table.get() if self.table.exists() else (-1, None)
        out, at = [], 0
        while len(held) - at >= self.size:
            own = held[at : at + self.size]
            p = own[0][0]
            if own[-1][0] != p:
                raise ValueError(f"stream {key[0]}: packet {p} has no {self.size} symbols")
            fresh = counts is None or p != before + 1 or self.reset_every and p % self.reset_every == 0
            _, pos, ch, sym = zip(*own, strict=True)
            out.append((key[0], p, coding.adaptive_packed(pos, ch, sym, coding.uniform_counts(self.n_sym) if fresh else counts, self.n_ch, self.lsh)))
            before, counts, at = p, np.bincount(sym[: self.cap], minlength=self.n_sym).tolist(), at + self.size
        if out:
            self.table.update((before, counts))
        self.open.put(held[at:]) if held[at:] else self.open.clear()
        yield pd.DataFrame(out, columns=["stream", "pkt", "bytes"])

    def close(self) -> None:
        pass


def streaming_adaptive(sym: DataFrame, n_ch: int, size: int, reset_every: int | None = None, n_sym: int = 64, cap: int = 4096 - 64, lsh: int = 11) -> DataFrame:
    """Symbols (stream, pkt, ch, pos, sym), size of them a packet -> stream, pkt, bytes, as `codecs.encode_adaptive` codes them."""
    coder = _Adaptive(n_ch, size, reset_every, n_sym, cap, lsh)
    return sym.select("stream", "pkt", "ch", "pos", "sym").groupBy("stream").transformWithStateInPandas(coder, "stream long, pkt long, bytes binary", "Append", "None")
