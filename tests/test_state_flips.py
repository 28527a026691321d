import pandas as pd

from axonwave import catalog
from axonwave.functions import coding
from axonwave.operators import codecs, wavelet
from axonwave.plans.samples import blocks, samples
from axonwave.plans.signal_queries import N

SF = "/root/testdata/sf0.01"


def test_every_packet_and_channel(spark):
    sym = codecs.whole_packets(wavelet.symbols(blocks(samples(spark, SF))), N)
    want = {(r.pkt, r.ch) for r in sym.select("pkt", "ch").distinct().collect()}
    got = catalog.queries()["state_flips"](spark, SF).collect()
    assert {(r.pkt, r.ch) for r in got} == want and len(got) == len(want) and max(p for p, _ in want) > 0
    assert all(r.found and r.candidates >= 1 and not r.clean for r in got)


def every_hypothesis(spark, d):
    """Which flipped bit of a coder state, after which symbol, explains a channel's bytes in a packet: every hypothesis is coded again."""
    sym = codecs.whole_packets(wavelet.symbols(blocks(samples(spark, d))), N)
    tables = codecs.trained_tables(sym)

    def run(s, k, x, start, flip=None, seen=None):
        """Bytes of the symbols from start on, coded from state x; None as soon as they are not those seen."""
        out = bytearray()
        for i in range(start, len(s)):
            t = tables[k[i]]
            x, units = coding.rans_step(x, t[s[i] + 1] - t[s[i]], t[s[i]], 4096, 2)
            out += bytes(units)
            if seen is not None and seen[len(out) - len(units) : len(out)] != bytes(units):
                return None
            if flip and flip[0] == i:
                x ^= 1 << flip[1]
        out = bytes(out) + x.to_bytes(4, "little")
        return out if seen is None or out == seen else None

    def one(pdf):
        pdf = pdf.sort_values("pos")
        s, k, c = pdf.sym.tolist(), pdf.ctx.tolist(), int(pdf.ch.iloc[0])
        truth = (11 + c, 3 + c % 5)
        seen = run(s, k, 4096 << 2, 0, truth)
        fits, x, n = [], 4096 << 2, 0
        for i in range(len(s)):
            t = tables[k[i]]
            x, units = coding.rans_step(x, t[s[i] + 1] - t[s[i]], t[s[i]], 4096, 2)
            if seen[n : n + len(units)] != bytes(units):  # no later flip explains a byte before it
                break
            n += len(units)
            fits += [(i, b) for b in range(14) if run(s, k, x ^ 1 << b, i + 1, seen=seen[n:]) is not None]
        return pd.DataFrame({"stream": [pdf.stream.iloc[0]], "pkt": [pdf.pkt.iloc[0]], "ch": [c], "found": [truth in fits], "candidates": [len(fits)], "clean": [run(s, k, 4096 << 2, 0) == seen]})

    return sym.groupBy("stream", "pkt", "ch").applyInPandas(one, "stream long, pkt long, ch int, found boolean, candidates long, clean boolean")


def test_as_many_as_coding_every_hypothesis_again(spark):
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(catalog.queries()["state_flips"](spark, SF)) == rows(every_hypothesis(spark, SF))
