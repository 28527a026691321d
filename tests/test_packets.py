"""Codecs as DataFrames on generated samples."""

import numpy as np

from axonwave.operators import codecs, wavelet
from axonwave.plans.samples import blocks
from axonwave.plans.signal_queries import lfsr_values


def _samples(spark, frames=512, n_ch=8):
    v = lfsr_values(frames * n_ch)
    return spark.createDataFrame([(0, i % n_ch, i // n_ch, c) for i, c in enumerate(v)], "stream long, ch int, frame long, code long")


def test_lossless(spark):
    x = _samples(spark)
    y = codecs.decode_lossless(codecs.encode_lossless(x), 8)
    assert y.exceptAll(x).isEmpty() and y.count() == 4096


def test_lossy_decodes_to_the_reconstruction(spark):
    x = _samples(spark)
    p, tables = codecs.lossy_packets(x, 8)
    y = codecs.decode_lossy(p, tables, 8)
    want = wavelet.reconstruction(blocks(x)).select("stream", "ch", "blk", "p", "y")
    assert y.exceptAll(want).isEmpty() and y.count() == 4096


def test_perfect_reconstruction_other_levels(spark):
    x = blocks(_samples(spark), 32)
    for levels in (1, 2, 3):
        assert wavelet.inverse(wavelet.forward(x, levels), levels).where("x != code").isEmpty()


def test_forward_against_arrays(spark):
    rows = wavelet.forward(blocks(_samples(spark, 64, 1)), 1).orderBy("p").collect()
    s = np.array(lfsr_values(64)) - 512
    e, o = s[::2], s[1::2]
    d = o - ((e + np.append(e[1:], e[-1])) >> 1)
    a = e + ((np.append(d[:1], d[:-1]) + d + 2) >> 2)
    assert [r.c for r in rows] == [v for pair in zip(a.tolist(), d.tolist()) for v in pair]
