"""Faults by meeting traces against coding every hypothesis again; damaged packets with and without snapshots."""

import random

import pytest
from pyspark.sql import functions as F

from axonwave.functions import coding, tracing
from axonwave.functions.tracing import Coded, Coder
from axonwave.operators import faults

N_CH, N_SYM, ESC = 3, 8, 7
R = random.Random(4)
TABLES = [coding.cumulative(coding.normalised([R.randint(1, 300) for _ in range(N_SYM)])) for _ in range(2)]
CODER = Coder(N_CH)
KEYS = ["stream", "pkt"]


def _packet(seed, n=90):
    r = random.Random(seed)
    rows = []
    for pos in range(n):
        ch, ctx, sym = pos % N_CH if r.random() < 0.9 else r.randrange(N_CH), r.randrange(2), r.choices(range(N_SYM), [9, 9, 9, 5, 3, 2, 1, 1])[0]
        v = r.randint(-400, 400) if sym == ESC else sym
        rows.append((pos, ch, ctx, sym, v))
    return rows


def _coded(rows):
    t = [TABLES[k] for _, _, k, _, _ in rows]
    raw = [(2 * v if v >= 0 else -2 * v - 1).to_bytes(2, "little") if s == ESC else b"" for _, _, _, s, v in rows]
    return Coded([r[1] for r in rows], [t[i][r[3] + 1] - t[i][r[3]] for i, r in enumerate(rows)], [t[i][r[3]] for i, r in enumerate(rows)], raw)


def _made(s, alter=None):
    """Payload with a fault; None where the fault cannot be coded."""
    bounds, out = tracing.forward(s, CODER, None, alter)
    end = bounds.get(len(s.ch))
    return out + CODER.tail(end[1]) if end else None


def _upset(j, kind, bit):
    def alter(k, x, f, c):
        if k != j:
            return x, f, c, None
        flip = lambda v, of: v ^ (1 << bit if kind == of else 0)
        return flip(x, "state"), flip(f, "frequency"), flip(c, "start"), lambda y: flip(y, "write_back")

    return alter


def _frames(spark, packets, payloads):
    rows = [(1, p, *r) for p, own in packets.items() for r in own]
    sym = spark.createDataFrame(rows, "stream long, pkt long, pos long, ch int, ctx int, sym int, v long").repartition(3)
    return faults.coded_symbols(sym, TABLES, ESC), spark.createDataFrame([(1, p, b) for p, b in payloads.items()], "stream long, pkt long, payload binary")


def test_upsets_are_those_of_coding_again(spark):
    packets, payloads, want, truth, p = {}, {}, {}, {}, 0
    for kind, bits in faults.UPSETS:
        for _ in range(6):
            rows = _packet(p, 60)
            s, j, bit = _coded(rows), R.randrange(60), R.randrange(bits)
            seen = _made(s, _upset(j, kind, bit))
            if seen is None or seen == _made(s):
                continue
            packets[p], payloads[p], truth[p] = rows, seen, (j, kind, bit)
            want[p] = {(k, h, b) for k in range(60) for h, n in faults.UPSETS for b in range(n) if _made(s, _upset(k, h, b)) == seen}
            p += 1
    assert p > 15
    coded, pay = _frames(spark, packets, payloads)
    rows = faults.traced(coded, pay, KEYS, CODER)
    got = {k: set() for k in packets}
    for r in faults.upsets(rows, KEYS, CODER).collect():
        got[r.pkt].add((r.k, r.kind, r.bit))
    for k in packets:
        assert truth[k] in got[k] and got[k] == want[k], (k, truth[k])
    assert not any(r.clean for r in rows.collect())


def test_stuck_bits_and_bounds(spark):
    rows = {p: _packet(100 + p) for p in range(6)}
    payloads, truth = {}, {}
    for p in range(6):
        s, of = _coded(rows[p]), (rows[p][20][2], rows[p][20][3])
        if p < 2:  # a table bit
            field, b = ("frequency", 3) if p else ("start", 2)
            at = [k for k, r in enumerate(rows[p]) if (r[2], r[3]) == of]
            flip = lambda k, x, f, c, at=at, field=field, b=b: (x, f ^ (1 << b) * (k in at and field == "frequency"), c ^ (1 << b) * (k in at and field == "start"), None)
            payloads[p], truth[p] = _made(s, flip), (f"{field}_stuck", *of, b, ((s.f if p else s.c)[at[0]] >> b & 1) ^ 1)
        elif p == 2:
            payloads[p], truth[p] = _made(s, lambda k, x, f, c: (x, f, c, lambda y: y | 1 << 4)), ("write_back_stuck", None, None, 4, 1)
        elif p == 3:
            payloads[p] = _made(s)
        else:  # two bytes: nothing explains it
            body = bytearray(_made(s))
            body[9] ^= 0x81
            body[20] ^= 0x42
            payloads[p] = bytes(body)
    coded, pay = _frames(spark, rows, payloads)
    got = {r.pkt: r for r in faults.traced(coded, pay, KEYS, CODER, stuck=True).collect()}
    for p in range(3):
        assert truth[p] in [tuple(f) for f in got[p].faults]
    assert got[3].clean and got[3].prefix == got[3].suffix == 90 and not got[3].meets and not got[3].faults
    for p in (4, 5):
        bounds, _ = tracing.forward(_coded(rows[p]), CODER)
        assert not got[p].faults and not got[p].clean
        assert got[p].prefix == max(k for k, (at, _) in bounds.items() if at <= 9) and got[p].suffix >= max(90 - k for k, (at, _) in bounds.items() if at > 20)
    assert {r.pkt for r in faults.upsets(faults.traced(coded, pay, KEYS, CODER), KEYS, CODER).collect()}.isdisjoint({3, 4, 5})


def test_symbols_do_not_carry_their_payload(spark):
    """No plan step below the traces has rows of symbols with the payload."""
    rows = _packet(3, 60)
    good = _made(_coded(rows))
    coded, pay = _frames(spark, {0: rows, 1: rows}, {0: good, 2: good})
    out = faults.traced(coded, pay, KEYS, CODER)
    assert "Join" not in out._jdf.queryExecution().sparkPlan().toString()
    assert [(r.pkt, r.n, r.clean) for r in out.collect()] == [(0, 60, True)]  # packets of one side only have no row


def test_tolerant_decoding(spark):
    one = _packet(7, 90)  # one order for all packets, as a format has
    rows = {p: [(pos, ch, ctx, *R.choice([(s, s) for s in range(ESC)] + [(ESC, R.randint(-400, 400))])) for pos, ch, ctx, _, _ in one] for p in range(6)}
    order = [(ch, ctx) for _, ch, ctx, _, _ in one]
    good = {p: _made(_coded(r)) for p, r in rows.items()}
    bad = dict(good)
    own = _coded(rows[1])
    bounds, _ = tracing.forward(own, CODER)
    at = next(bounds[k][0] for k in range(40, 90) if not own.raw[k] and bounds[k + 1][0] > bounds[k][0])  # the bytes of escapes carry no check
    bad[1] = good[1][:at] + bytes([good[1][at] ^ 8]) + good[1][at + 1 :]
    bad[2] = good[2][:15] + good[2][16:]  # a byte lost
    bad[3] = good[3][:15] + b"\x55" + good[3][15:]  # a byte more
    bad[4], bad[5] = b"", good[5][:7]
    coded, pay = _frames(spark, rows, bad)
    whole = {r.pkt: r for r in faults.decode_tolerant(pay, KEYS, order, TABLES, CODER, esc=ESC).collect()}
    assert len(whole) == 6 and [whole[p].clean for p in range(6)] == [True] + [False] * 5
    assert whole[0].syms == [r[3] for r in rows[0]] and all(len(w.syms) == 90 for w in whole.values())
    snaps = faults.snapshots(coded, KEYS, CODER, 10)
    segs = faults.decode_tolerant(pay, KEYS, order, TABLES, CODER, snaps, esc=ESC).collect()
    assert len(segs) == 6 * 9
    for r in segs:
        want = rows[r.pkt][r.k : r.k + 10]
        if r.clean:
            assert r.syms == [w[3] for w in want]
            assert [bytes(b) for b in r.raws] == _coded(want).raw
    clean = {p: sum(r.clean for r in segs if r.pkt == p) for p in range(6)}
    assert [clean[p] for p in range(4)] == [9, 8, 8, 8] and clean[4] <= 1 and clean[5] < 9


def test_a_coder_that_falls_back_into_step_is_not_clean(spark):
    """A wrong byte that changes two symbols and leads to the right states with no byte left."""
    rows = _packet(75, 40)
    good, order = _made(_coded(rows)), [(r[1], r[2]) for r in rows]
    bad = good[:12] + bytes([good[12] ^ 8]) + good[13:]
    body, states = CODER.parted(bad)
    syms, _, first, left, short = tracing.undone(body, states, order, TABLES, CODER, ESC)
    assert syms != [r[3] for r in rows] and first == [CODER.low] * N_CH and left == 0 and not short
    coded, pay = _frames(spark, {0: rows, 1: rows}, {0: good, 1: bad})
    got = {r.pkt: r for r in faults.decode_tolerant(pay, KEYS, order, TABLES, CODER, faults.snapshots(coded, KEYS, CODER, 64), esc=ESC).collect()}
    assert got[0].clean and got[0].syms == [r[3] for r in rows] and not got[1].clean


@pytest.mark.parametrize("seed", range(3))
def test_traces_meet_everywhere_in_a_good_packet(seed):
    s = _coded(_packet(seed))
    body, states = CODER.parted(_made(s))
    ahead, _ = tracing.forward(s, CODER, body)
    back = tracing.backward(s, CODER, body, states)
    assert ahead == back and len(ahead) == 91


def test_coded_symbols(spark):
    rows = _packet(1)
    coded, _ = _frames(spark, {0: rows}, {})
    s = _coded(rows)
    got = coded.orderBy("pos").collect()
    assert [r.f for r in got] == s.f and [r.c for r in got] == s.c and [bytes(r.raw or b"") for r in got] == s.raw
    assert coded.where(F.col("raw").isNotNull()).count() == sum(r[3] == ESC for r in rows)
