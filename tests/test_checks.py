"""Stream checks on hand-made captures."""

from axonwave.operators.checks import readback, stream_findings, verdicts

TOKENS = "stream long, pos long, kind string, v long, last boolean"


def _capture(stream, data, ends=(), other=()):
    """Bytes with ends at places, and other tokens (place, kind) after the byte there."""
    out, pos = [], 0
    for k, v in enumerate(data):
        out.append((stream, pos, "B", v, k in ends))
        pos += 1
        for place, kind in other:
            if place == k:
                out.append((stream, pos, kind, None, False))
                pos += 1
    return out


def test_findings(spark):
    good = [64 + k // 4 if k % 4 == 0 else (k * 37) % 256 for k in range(40)]  # packets of four bytes, headers that count
    ends = range(3, 40, 4)
    t = _capture(1, good, ends) + _capture(2, [7] * 12, (11,)) + _capture(3, good) + _capture(4, [v | 16 for v in good], ends) + _capture(5, good[:8] + good[12:], range(3, 36, 4)) + _capture(6, [*good, 1, 2], ends, [(1, "A"), (40, "O")])
    want = [(s, v) for s in range(1, 8) for v in good]
    f = stream_findings(spark.createDataFrame(t, TOKENS), spark.createDataFrame(want, "stream long, v long"), spark.createDataFrame([(s,) for s in range(1, 8)], "stream long"), least=30)
    got = {(r.stream, r.kind, r.packet, r.data) for r in f.collect()}
    assert {g for g in got if g[0] == 1} == set()
    assert {g[1:] for g in got if g[0] == 2} == {("stuck_output", None, 7)}
    assert {g[1:] for g in got if g[0] == 3} == {("no_last", None, None)}
    assert ("pin_stuck", None, 4) in {g[1:] for g in got if g[0] == 4} and not any(g[1] == "pin_stuck" and g[3] != 4 for g in got)
    assert {g[1:] for g in got if g[0] == 5} == {("seq_gap", 2, 1)}
    six = {g[1:] for g in got if g[0] == 6}
    assert ("trailing", None, 2) in six and ("abort", 0, 1) in six
    assert {g[1:] for g in got if g[0] == 7} == {("no_output", None, None)}
    lead = {r.stream: (r.kind, r.of) for r in verdicts(f).collect()}
    assert lead[4][0] == "pin_stuck" and lead[7] == ("no_output", 1) and lead[5] == ("seq_gap", 1) and 1 not in lead


def test_readback(spark):
    r = [(1, a, a, a) for a in range(4)] + [(2, a, 255, a) for a in range(4)] + [(3, a, a ^ (2 if a == 3 else 8 if a == 1 else 0), a) for a in range(4)] + [(4, 0, 1, 0)]
    got = {(x.stream, x.kind, x.data) for x in readback(spark.createDataFrame(r, "stream long, addr long, got long, want long")).collect()}
    assert got == {(2, "readback_dead", None), (3, "readback_bits", 10), (4, "readback_bits", 1)}
