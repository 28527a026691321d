"""Coders with state in a stream give the batch codecs' bytes, over micro-batches and restarts; adaptive packets decode from bytes alone."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from axonwave.operators import codecs
from axonwave.streaming import coder

N_CH, FRAMES = 4, 300


@pytest.fixture(scope="module")
def samples(spark):
    r, rows = random.Random(1), []
    for stream in (3, 9):
        level = [512] * N_CH
        for t in range(FRAMES + 40 * (stream == 9)):
            for c in range(N_CH):
                level[c] = min(1023, max(0, level[c] + r.randint(-40, 40)))
                rows.append((stream, c, t, r.choice([level[c]] * 20 + [0, 1023])))
    return spark.createDataFrame(rows, "stream long, ch int, frame long, code long").cache()


def _drain(spark, made, at):
    """All that is at the source now, one file a micro-batch, from the checkpoint on."""
    with coder.state_store(spark):
        q = made.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()


def _put(df, at):
    df.coalesce(1).write.mode("append").parquet(at)


def _bytes(df):
    return {(r.stream, r.pkt): bytes(r.bytes) for r in df.collect()}


def test_lossless_packets_over_batches_and_a_restart(spark, samples, tmp_path):
    src, want = str(tmp_path / "in"), _bytes(codecs.encode_lossless(samples))
    assert len(want) == 4
    stream = lambda: coder.streaming_rice(spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", 1).parquet(src))
    for k, (lo, hi) in enumerate([(0, 100), (100, 101), (101, 260)]):  # cut inside packets
        _put(samples.where(f"frame >= {lo} AND frame < {hi}"), src)
        if k != 1:  # the second file waits, so one run has two micro-batches
            _drain(spark, stream(), tmp_path)
    got = _bytes(coder.lossless_packets(spark.read.parquet(f"{tmp_path}/out"), N_CH))
    assert got == {k: b for k, b in want.items()}
    _put(samples.where("frame >= 260 AND ch < 2"), src)  # a channel may run ahead of others
    _put(samples.where("frame >= 260 AND ch >= 2"), src)
    _drain(spark, stream(), tmp_path)
    assert _bytes(coder.lossless_packets(spark.read.parquet(f"{tmp_path}/out"), N_CH)) == want
    _put(samples.where("frame = 5"), src)
    with pytest.raises(Exception, match="in place of"):
        _drain(spark, stream(), tmp_path)


def test_a_large_micro_batch_leaves_in_pieces():
    """Packets come out a few at a time, and the state follows the last of them."""
    kept = {}

    class Kept:
        exists = lambda self: "coder" in kept
        get = lambda self: kept["coder"]
        update = lambda self, v: kept.__setitem__("coder", v)
        put = lambda self, v: kept.__setitem__("open", v)

    p = coder._Rice(coder.RiceConfig())
    p.coder = p.open = Kept()
    n = 128 * (2 * coder.PIECE + 1) + 5
    rows = pd.DataFrame({"frame": np.arange(n)[::-1], "code": np.arange(n)[::-1] % 700})
    sizes = [len(out) for out in p.handleInputRows((3, 1), iter([rows[:1000], rows[1000:]]), None)]
    assert sizes == [coder.PIECE, coder.PIECE, 1] and kept["coder"][0] == n and len(kept["open"]) == 5


@pytest.fixture(scope="module")
def symbols(samples):
    """64 frames a packet, coded channel by channel."""
    s = samples.select("stream", F.floor(F.col("frame") / 64).alias("pkt"), "ch", (F.pmod("frame", F.lit(64)) * N_CH + F.col("ch")).alias("pos"), F.least(F.lit(63), F.floor(F.col("code") / 20)).cast("long").alias("sym"))
    return s.where("pkt < 4").cache()


@pytest.mark.parametrize("reset", [None, 2])
def test_adaptive_packets_over_batches(spark, symbols, tmp_path, reset):
    src, want = str(tmp_path / "in"), _bytes(codecs.encode_adaptive(symbols, N_CH, reset, cap=200))
    assert len(want) == 8
    stream = lambda: coder.streaming_adaptive(spark.readStream.schema(symbols.schema).option("maxFilesPerTrigger", 1).parquet(src), N_CH, 64 * N_CH, reset, cap=200)
    for cut in ("pkt = 0 OR pkt = 1 AND pos < 7", "pkt = 1 AND pos >= 7 AND pos < 90", "pkt = 1 AND pos >= 90 OR pkt > 1"):
        _put(symbols.where(cut), src)
        _drain(spark, stream(), tmp_path)
    assert _bytes(spark.read.parquet(f"{tmp_path}/out")) == want


def test_adaptive_decodes_from_bytes_alone(spark, symbols):
    channels = [k % N_CH for k in range(64 * N_CH)]
    rows = lambda df: Counter(tuple(r) for r in df.select("stream", "pkt", "ch", "pos", "sym").collect())
    for reset in (None, 2, 3):
        p = codecs.encode_adaptive(symbols, N_CH, reset)
        assert rows(codecs.decode_adaptive(p, channels, N_CH, reset)) == rows(symbols)
    broken = p.withColumn("bytes", F.when((F.col("pkt") == 1) & (F.col("stream") == 3), F.unhex(F.lit("00" * 20))).otherwise(F.col("bytes")))
    lost = {(3, 1), (3, 2)}  # the damaged one, and what depends on it up to the reset at 3
    assert rows(codecs.decode_adaptive(broken, channels, N_CH, 3)) == Counter({k: n for k, n in rows(symbols).items() if k[:2] not in lost})
    assert rows(codecs.decode_adaptive(p.where("pkt != 0 OR stream = 9"), channels, N_CH, 3)) == Counter({k: n for k, n in rows(symbols).items() if k[0] == 9 or k[1] == 3})
