"""Sequential folds by ranges and islands give what one pass over a channel gives."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from axonwave.functions import coding
from axonwave.operators import codecs

R = random.Random(2)


def _walk(n, jump):
    x, out = 512, []
    for _ in range(n):
        x = min(1023, max(0, x + R.randint(-jump, jump)))
        out.append(x)
    return out


@pytest.mark.parametrize("codes", [[], [1023], _walk(40, 300), _walk(700, 20), [0] * 300, [1023] * 300, [0, 1023] * 200])
def test_mean_map(codes):
    cfg = coding.FrontEnd()
    lows, ends = coding.mean_map(codes, cfg)
    starts = np.arange(1 << 13)
    _, want = coding.high_pass(np.tile(np.array(codes, np.int64)[:, None], (1, len(starts))), cfg, starts)
    assert (np.array(ends)[np.searchsorted(lows, starts, side="right") - 1] == want).all()


def test_high_pass_and_spikes_by_ranges(spark):
    rows = [(s, c, t, v) for s in range(2) for c in range(3) for t, v in enumerate(_walk(900 + 100 * c, 150)) if not (c == 1 and 256 <= t < 420)]  # a gap of whole ranges
    x = spark.createDataFrame(rows, "stream long, ch int, frame long, code long").repartition(3)
    want = {}
    for s in range(2):
        for c in range(3):
            own = [r for r in rows if r[:2] == (s, c)]
            hp, _ = coding.high_pass(np.array([[r[3]] for r in own]))
            want |= {(*r[:3],): h for r, h in zip(own, hp[:, 0].tolist(), strict=True)}
    for span in (64, 1 << 16):
        hp = codecs.high_passed(x, span=span)
        assert {(r.stream, r.ch, r.frame): r.hp for r in hp.collect()} == want
    thr = codecs.thresholds(hp, 0.8)
    level = {(r.stream, r.ch): r.thr for r in thr.collect()}
    got = sorted(tuple(r) for r in codecs.spikes(hp, thr).collect())
    low = {k: [t for (s, c, t), h in want.items() if (s, c) == k and h <= -level[k]] for k in level}
    assert got == sorted((*k, t) for k in level for t in coding.after_dead_time(sorted(low[k]), 20)) and len(got) > 50


def _greedy(a, b, reach):
    """Every one of a looks at all of b."""
    used, hits, far = set(), 0, 0
    for t in a:
        free = [j for j, u in enumerate(b) if j not in used and abs(u - t) <= reach]
        if free:
            used.add(free[0])
            hits, far = hits + 1, far + abs(b[free[0]] - t)
    return hits, len(b) - hits, far


def test_matching(spark):
    rows = []
    for ch in range(20):
        a, b = (sorted(R.sample(range(600), R.randint(0, 90))) for _ in "ab")
        rows += [(1, ch, t, o) for o, of in (("a", a), ("b", b)) for t in of]
        assert coding.matched(a, b) == _greedy(a, b, 10)
    t = spark.createDataFrame(rows, "stream long, ch int, frame long, of string").repartition(4)
    for r in codecs.matched_spikes(t.where("of = 'a'"), t.where(F.col("of") == "b")).collect():
        a, b = ([x[2] for x in rows if x[1] == r.ch and x[3] == o] for o in "ab")
        assert (r.orig, r.hits, r.false_pos, r.distance) == (len(a), *_greedy(a, b, 10))


def test_carried_over_batches(spark):
    from axonwave.operators.folds import carried

    x = spark.range(5000).select((F.col("id") % 7).alias("k"), F.lit("x").alias("g"), (F.col("id") * 37 % 5003).alias("t"), F.col("id").alias("v"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        step = lambda s, rows: ((s[0] + 1, s[1] * 3 % 1009 + int(rows.v.sum()), [*s[2], *rows.t]), None)
        import pandas as pd

        end = lambda key, s: pd.DataFrame({"k": [key[0]], "pieces": [s[0]], "n": [len(s[2])], "sorted": [s[2] == sorted(s[2])]})
        got = carried(x, ["k", "g"], "t", lambda: (0, 0, []), step, end, "k long, pieces long, n long, sorted boolean").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 7 and sum(r.n for r in got) == 5000 and all(r.sorted and r.pieces > 5 for r in got)
