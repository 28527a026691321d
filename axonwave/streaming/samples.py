"""Streaming forms: count windows as time windows, and the high-pass front end with state for each channel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from axonwave.functions.coding import FrontEnd, high_pass

FRAME_US = 51.2


def with_time(x: DataFrame, frame_us: float = FRAME_US) -> DataFrame:
    """Event time from the frame number."""
    return x.withColumn("ts", F.timestamp_micros((F.col("frame") * frame_us).cast("long")))


def packet_counts(x: DataFrame, frames: int = 256, late: str = "1 second") -> DataFrame:
    """Samples and sum of codes of each packet window and channel; a watermark bounds the state."""
    span = f"{int(frames * FRAME_US * 10)} microseconds" if frames * FRAME_US % 1 else f"{int(frames * FRAME_US)} microseconds"
    pkt = F.floor(F.col("frame") / frames).alias("pkt")
    return with_time(x).withWatermark("ts", late).groupBy(F.window("ts", span), "stream", "ch", pkt).agg(F.count("*").alias("n"), F.sum("code").alias("total")).drop("window")


def streaming_high_pass(x: DataFrame, cfg: FrontEnd = FrontEnd()) -> DataFrame:
    """stream, ch, frame, hp: the running mean is kept for each channel between batches.

    Frames of a channel must arrive in order of batches; within a batch they are sorted.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("frame")
        acc = np.array(state.get) if state.exists else None
        hp, acc = high_pass(rows[["code"]].to_numpy(), cfg, acc)
        state.update((int(acc[0]),))
        yield pd.DataFrame({"stream": key[0], "ch": key[1], "frame": rows.frame.to_numpy(), "hp": hp[:, 0]})

    return x.groupBy("stream", "ch").applyInPandasWithState(step, "stream long, ch int, frame long, hp long", "acc long", "append", GroupStateTimeout.NoTimeout)


def lifted(x: np.ndarray, levels: int = 3) -> np.ndarray:
    """Wavelet coefficients of blocks (rows), each at the place of its sample: odd places of every stride less the mean of their neighbours, then even ones."""
    c = x.astype(np.int64)
    for stride in (1 << level for level in range(levels)):
        v = c[:, ::stride]
        even, odd = v[:, ::2], v[:, 1::2]
        odd -= (even + np.concatenate([even[:, 1:], even[:, -1:]], 1)) >> 1
        even += (np.concatenate([odd[:, :1], odd[:, :-1]], 1) + odd + 2) >> 2
    return c


def streaming_coefficients(x: DataFrame, block: int = 64, levels: int = 3, centre: int = 512) -> DataFrame:
    """stream, ch, blk, p, c of whole blocks: a channel's state is the samples of its open block, fewer than block of them.

    Frames of a channel must arrive in order of batches; within a batch they are sorted. The same rows as the wavelet of a batch query.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("frame")
        first, held = state.get if state.exists else (int(rows.frame.iloc[0]), [])
        codes = np.concatenate([np.array(held, np.int64), rows.code.to_numpy(dtype=np.int64)])
        whole = len(codes) // block
        state.update((first + whole * block, codes[whole * block :].tolist()))
        c = lifted(codes[: whole * block].reshape(-1, block) - centre, levels)
        blk = first // block + np.repeat(np.arange(whole), block)
        yield pd.DataFrame({"stream": key[0], "ch": key[1], "blk": blk, "p": np.tile(np.arange(block, dtype=np.int32), whole), "c": c.reshape(-1)})

    return x.groupBy("stream", "ch").applyInPandasWithState(step, "stream long, ch int, blk long, p int, c long", "first long, held array<long>", "append", GroupStateTimeout.NoTimeout)
