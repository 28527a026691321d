"""Graph searches and latencies against plain loops over random graphs and streams."""

import random
from collections import Counter, defaultdict

import pytest

from axonwave.operators.graphs import block_labels, majority, nearest_labels, reach
from axonwave.operators.latency import delivery_latency, next_at

R = random.Random(8)


@pytest.fixture(scope="module")
def graph(spark):
    edges = {(f"n{R.randrange(60)}", f"n{R.randrange(60)}") for _ in range(75)} | {("n0", f"n{k}") for k in range(20, 50)}  # cycles, and a hot node
    labels = [(f"n{k}", f"L{R.randrange(4)}") for k in (1, 7, 13, 40, 40, 59, 77)]
    return sorted(edges), labels, spark.createDataFrame(sorted(edges), "src string, dst string").repartition(3), spark.createDataFrame(labels, "node string, label string")


def _search(edges, node, most):
    """depth of everything within reach."""
    out, front = {node: 0}, [node]
    for depth in range(1, most + 1):
        front = sorted({b for a, b in edges if a in front and b not in out})
        out |= dict.fromkeys(front, depth)
    return out


def test_reach(graph, spark):
    edges, _, e, _ = graph
    roots = ["n0", "n3", "n99"]
    for most in (None, 2):
        got = {(r.root, r.node): r.depth for r in reach(spark.createDataFrame([(x,) for x in roots], "node string"), e, most).collect()}
        assert got == {(x, y): k for x in roots for y, k in _search(edges, x, most or 99).items()}


@pytest.mark.parametrize("down", [True, False])
@pytest.mark.parametrize("most", [0, 1, 3, 50])
def test_nearest_labels(graph, down, most):
    edges, labels, e, names = graph
    of = defaultdict(list)
    for n, x in labels:
        of[n].append(x)
    along = edges if down else [(b, a) for a, b in edges]
    want = {}
    for node in {n for x in edges for n in x} | set(of):
        near = [(k, min(of[y])) for y, k in _search(along, node, most).items() if y in of]
        if near:
            want[node] = min(near)
    got = {r.node: (r.depth, r.label) for r in nearest_labels(e, names, most, down).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert got == want


def test_blocks_and_majority(graph, spark):
    edges, labels, e, names = graph
    nodes = sorted({n for x in edges for n in x} | {"alone"})
    got = {r.node: (r.label, r.way) for r in block_labels(e, spark.createDataFrame([(n,) for n in nodes], "node string"), names, 3, 2).collect()}
    down, up = ({r.node: r.label for r in nearest_labels(e, names, k, d).collect()} for k, d in ((3, True), (2, False)))
    assert got == {n: (down[n], "down") if n in down else (up[n], "up") if n in up else ("core", "none") for n in nodes}
    members = [(f"g{k % 5}", n) for k, n in enumerate(nodes)]
    votes = defaultdict(Counter)
    for g, n in members:
        votes[g][got[n][0]] += 1
    m = majority(spark.createDataFrame(members, "group string, node string"), spark.createDataFrame([(n, x) for n, (x, _) in got.items()], "node string, label string"))
    assert {r.group: (-r.votes, r.label) for r in m.collect()} == {g: min((-n, x) for x, n in c.items()) for g, c in votes.items()}


def test_latencies(spark):
    rows = [(s, c, R.choice("psse")) for s in range(5) for c in sorted(R.sample(range(1000), 120))]
    df = spark.createDataFrame(rows, "stream long, clock long, kind string").repartition(4)
    of = lambda k: df.where(f"kind = '{k}'").drop("kind")
    plain = lambda s, k: [c for t, c, x in rows if t == s and x == k]
    for r in next_at(of("p"), of("e"), ["stream"], "clock", "next").collect():
        assert r.next == min((c for c in plain(r.stream, "e") if c >= r.clock), default=None)
    want = {}
    for s in range(5):
        for n, (p, c) in enumerate(zip(plain(s, "p"), plain(s, "s")[3:]), 1):
            end = min((x for x in plain(s, "e") if x >= c), default=None)
            want[s, n] = (p, c, end, c - p, end - p if end is not None else None)
    got = {(r.stream, r.n): tuple(r)[2:] for r in delivery_latency(of("p"), of("s"), of("e"), ["stream"], 3).collect()}
    assert got == want and len(got) > 50
    assert next_at(of("p"), of("p"), ["stream"], "clock", "next").where("next != clock").isEmpty()
