"""Connected groups from buckets of candidates, without all pairs of a bucket.

Two nodes that share a bucket are candidates. In a round of stars every bucket's nodes are tested against one of
them, its head: the node that meets most others over all buckets (of a group of near copies that is the text they
were made from, or what is nearest to it). Nodes that are connected by then need no further test among each other, and a head
is done with. While the pairs that are left outnumber the rows there were and a round lowers them well, another follows, with other heads; those that
remain are tested pair by pair: of each bucket those of different groups that are not both in its largest one.
Every link that could join two groups is thus tested or implied, so the groups are exact.

Everything is joins, combined aggregates and windows on thin rows; hot keys are split by Spark's skew joins, and the windows of a bucket, which spill, count
its rows and find its head. Each table is dropped as soon as it has been read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axonwave.llm.common import forget, written


def _joined(batches):
    """Labels of links that fit into one task: union-find over the array of their nodes."""
    import numpy as np
    import pyarrow as pa

    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if len(b)]
    if not held:
        return
    a, b = (np.concatenate(x) for x in zip(*held, strict=True))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    top = list(range(len(nodes)))

    def find(x):
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        x, y = find(x), find(y)
        top[max(x, y)] = min(x, y)
    least = np.array([find(x) for x in range(len(top))], np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[least])], ["node", "component"])


def components(links: DataFrame, in_a_task: int = 500_000) -> DataFrame:
    """links(a, b) -> node, component: the smallest node that can be reached. Nodes without links do not occur.

    Up to in_a_task links, 8 MB, are joined in a single task. More take rounds of taking the least label among the neighbours and then the label's own label (pointer
    jumping); labels are a table each round, so a lost executor costs one round.
    """
    if links.limit(in_a_task + 1).count() <= in_a_task:
        return written(links.select("a", "b").coalesce(1).mapInArrow(_joined, "node long, component long"), "labels")
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    both = written(both, "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("component").alias("far"))
        new = written(step.join(jump, "mid", "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("component")), "labels")
        changed = not new.where("old != component").isEmpty()
        forget(labels)
        labels = new.select("node", "component")
        labels._axonwave_path = new._axonwave_path
        if not changed:
            forget(both)
            return labels


def linked_groups(
    buckets: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    allowed: Callable[[DataFrame], DataFrame] = lambda pairs: pairs,
    carry: tuple[str, ...] = (),
    near: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None,
    large: int = 32,
    plain: bool = False,
    batch: str = "16m",
    attributes: DataFrame | None = None,
    alike: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None,
) -> DataFrame:
    """buckets(bucket, node, *carry), rows may repeat -> node, component of the graph of verified candidate pairs.

    verify(pairs(a, b)) returns the pairs that are links; allowed(pairs) may drop pairs that cannot be, cheaply.
    near(x, y), given the carried columns of two rows of a bucket, may be false where this bucket need not make them a pair.
    alike(x, y), given the attributes of two nodes (node and more, a row for each and perhaps for others), must hold for a pair whatever the bucket.
    large: in buckets of so many nodes the head is tested against all.
    plain: rows do not repeat and the carried columns are the node's alone; then buckets with the same nodes make the same pairs, and are one.
    batch: most bytes of an Arrow batch of what verify and attributes read.
    """
    near, alike = near or (lambda x, y: F.lit(True)), alike or (lambda x, y: F.lit(True))
    # a bucket's rows and then a node's meet once each, thin and sorted, in place of aggregates that are joined to what they were made from
    held = buckets.repartition("bucket")
    bucket, weight = Window.partitionBy("bucket"), F.col("of")
    held = (held if plain else held.distinct()).withColumn("of", F.count("*").over(bucket))
    if plain:  # every node of such buckets keeps the same one of them
        held = held.withColumn("nodes", F.bit_xor(F.xxhash64("node")).over(bucket)).where("of > 1").repartition("node")
        held, weight = held.groupBy("node", *carry, "of", "nodes").agg(F.min("bucket").alias("bucket"), F.count("*").alias("times")), F.col("of") * F.col("times")
    held = held.where("of > 1").withColumn("w", F.sum(weight).over(Window.partitionBy("node")))
    left = written(held.select("bucket", "node", *carry, "of", "w"), "left")
    more = ()
    if attributes is not None:
        attributes = written(attributes, "attributes", batch)
        more = tuple(c for c in attributes.columns if c != "node" and c not in carry)
    links, found, tested = [], None, []
    enough, before_pairs = left.count(), float("inf")
    while True:
        order = F.struct("w", F.xxhash64("node", "bucket"))
        own = left.withColumn("h", F.max(F.struct(order.alias("o"), "node", *carry)).over(Window.partitionBy("bucket")))
        if found is not None:  # nodes of the head's own group need no test
            own = own.join(found.select(F.col("node").alias("_n"), F.col("component").alias("_g")), F.col("h.node") == F.col("_n"), "left").where("NOT g <=> coalesce(_g, h.node) OR node = h.node")
        own = written(own, "own")
        here, head = (lambda c: F.col(c)), (lambda c: F.col(f"h.{c}"))
        # a test more in a large bucket saves many pairs later, so there the head is tested against all
        stars = own.where("node != h.node").where(near(here, head) | (F.col("of") >= large)).select(F.least("h.node", "node").alias("a"), F.greatest("h.node", "node").alias("b")).distinct()
        for t in tested:
            stars = stars.join(t, ["a", "b"], "left_anti")
        if attributes is not None:
            side = lambda c: attributes.select(F.col("node").alias(c), F.struct("*").alias(f"_{c}"))
            stars = stars.join(side("a"), "a").join(side("b"), "b").where(alike(lambda c: F.col(f"_a.{c}"), lambda c: F.col(f"_b.{c}"))).select("a", "b")
        star = written(allowed(stars), "stars")
        new = written(verify(star).select("a", "b"), "links", batch)
        tested.append(star)
        fresh = not links or not new.isEmpty()
        links.append(new)
        done = own.where("node = h.node").select("bucket", "node")
        if fresh:
            before, found = found, components(_all(links))
            forget(before)
        named = left.drop("g").join(done, ["bucket", "node"], "left_anti").join(found.withColumnRenamed("component", "g"), "node", "left").withColumn("g", F.coalesce("g", "node"))
        named = written(named, "named")
        forget(left), forget(own)
        by = named.groupBy("bucket", "g").agg(F.count("*").alias("n_g")).groupBy("bucket").agg(F.count("*").alias("groups"), F.sum("n_g").alias("n"), F.sum(F.col("n_g") * F.col("n_g")).alias("same"), F.max(F.struct("n_g", "g")).alias("main"))
        by = written(by.where("groups > 1").select("bucket", "n", "same", F.col("main.g").alias("main")), "counts")
        total = by.agg(F.sum("n").alias("rows"), F.sum((F.col("n") * F.col("n") - F.col("same")) / 2).alias("pairs")).first()
        left = written(named.join(by.select("bucket", "main"), "bucket"), "left")
        forget(named), forget(by)
        if not total.rows:
            forget(left)
            return _result(found, links, tested)
        if total.pairs <= max(enough, 100_000) or total.pairs > 0.8 * before_pairs:
            break
        before_pairs = total.pairs
        left = _without(left, "main")
    if attributes is not None:
        left = written(left.join(attributes.select("node", *more), "node"), "left")
    carry += more
    x = left.where("g != main").select("bucket", F.col("node").alias("x"), F.col("g").alias("gx"), *[F.col(c).alias(f"{c}_x") for c in carry])
    y = left.select("bucket", F.col("node").alias("y"), F.col("g").alias("gy"), (F.col("g") == F.col("main")).alias("in_main"), *[F.col(c).alias(f"{c}_y") for c in carry])
    both = (lambda c: F.col(f"{c}_x")), (lambda c: F.col(f"{c}_y"))
    rest = x.join(y, (x.bucket == y.bucket) & F.expr("gx != gy AND (in_main OR x < y)") & near(*both) & alike(*both))
    rest = rest.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    for t in tested:
        rest = rest.join(t, ["a", "b"], "left_anti")
    rest = written(allowed(rest), "rest")
    forget(left)
    more = written(verify(rest).select("a", "b"), "links", batch)
    forget(rest)
    if not more.isEmpty():
        links.append(more)
        before, found = found, components(_all(links))
        forget(before)
    return _result(found, links, tested)


def _without(df: DataFrame, column: str) -> DataFrame:
    out = df.drop(column)
    out._axonwave_path = df._axonwave_path
    return out


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _result(found: DataFrame, links: list[DataFrame], tested: list[DataFrame]) -> DataFrame:
    for t in [*links, *tested]:
        forget(t)
    return found
