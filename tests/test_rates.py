"""The rate table against the codecs' packets, coded and decoded one by one."""

import numpy as np

from axonwave.functions import coding
from axonwave.operators import codecs, rates, wavelet
from axonwave.plans.samples import blocks
from axonwave.sources import files

N_CH, FIRST, RATE = 2, 512, 1000.0


def test_mode_rates(spark):
    x = files.synthetic(spark, 1, N_CH, FIRST + 1300, 9).cache()
    got = {r.mode: r for r in rates.mode_rates(x, N_CH, FIRST, RATE).collect()}
    code = {(r.frame, r.ch): r.code for r in x.collect()}
    a = np.array([[code[t, c] for c in range(N_CH)] for t in range(FIRST + 1300)])
    cal, rest = a[:FIRST], a[FIRST:]
    # mode 0: packets of 128 frames
    data = [coding.rice_packet(rest[k * 128 : (k + 1) * 128], k) for k in range(10)]
    assert (got[0].packets, got[0].n_bytes, got[0].samples, got[0].note) == (10, sum(map(len, data)), 2560, 1.0)
    assert abs(got[0].bps - 8 * sum(map(len, data)) / 2560) < 1e-9 and abs(got[0].vs_16 * got[0].bps - 16) < 1e-9 and abs(got[0].vs_10 * got[0].bps - 10) < 1e-9
    # mode 1: tables of the first part only
    c, r = rates.calibrated(x, FIRST)
    tables = codecs.trained_tables(wavelet.symbols(blocks(c)))
    p = codecs.lossy_packets(r, N_CH, tables=tables)[0].collect()
    assert (got[1].packets, got[1].n_bytes, got[1].samples) == (5, sum(len(q.bytes) for q in p), 2560)
    y = {(q.blk * 64 + q.p, q.ch): (q.code, q.y) for q in wavelet.reconstruction(blocks(r)).collect() if q.blk < 20}
    m = np.array([[y[t, ch] for ch in range(N_CH)] for t in range(1280)], float)
    snr = 10 * np.log10(((m[..., 0] - m[..., 0].mean(0)) ** 2).sum() / ((m[..., 1] - m[..., 0]) ** 2).sum())
    assert abs(got[1].note - snr) < 1e-6 and got[1].vs_feature is None
    # modes 2 and 3: bins of 400 frames after the front end, thresholds of the first part
    hp_cal, _ = coding.high_pass(cal)
    hp, _ = coding.high_pass(rest)
    thr = np.maximum(1, np.rint(4.5 * np.median(np.abs(hp_cal), axis=0) / 0.6745))
    counts = np.zeros((3, N_CH), int)
    for ch in range(N_CH):
        for t in coding.after_dead_time(np.flatnonzero(hp[:, ch] <= -thr[ch]).tolist(), 20):
            if t < 1200:
                counts[t // 400, ch] += 1
    counts = np.minimum(counts, 7)
    two = [coding.spike_packet(row.tolist(), k) for k, row in enumerate(counts)]
    power = np.minimum(255, np.abs(hp[:1200]).reshape(3, 400, N_CH).sum(1) >> 6)
    three = [coding.band_packet(row.tolist(), k) for k, row in enumerate(power)]
    for mode, own, bits, note in ((2, two, 3, counts.sum() * RATE / (1200 * N_CH)), (3, three, 8, (power > 0).mean())):
        assert (got[mode].packets, got[mode].n_bytes) == (3, sum(map(len, own)))
        assert abs(got[mode].vs_feature - bits * 3 * N_CH / (8 * sum(map(len, own)))) < 1e-9 and abs(got[mode].note - note) < 1e-9
    assert rates.mode_rates(x.where("frame < 600"), N_CH, FIRST, RATE).count() == 0
