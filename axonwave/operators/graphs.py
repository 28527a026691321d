"""Searches over a graph given as edges (src, dst), round by round.

Every round's frontier is a table in the shared folder, one folder a round of one table: the next round reads the last folder and what has been seen is the
whole table, so plans do not grow and a lost executor costs one round's tasks. A round is a join of the frontier with the edges; hot nodes are
split by the adaptive join, and candidates for a node are combined before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonwave.sources.folders import new_folder


def reach(roots: DataFrame, edge: DataFrame, most: int | None = None) -> DataFrame:
    """root, node, depth of everything reachable from roots(node) in at most so many steps (None: all), each node once for each root."""
    spark, at = edge.sparkSession, new_folder(edge.sparkSession, "reach")
    put = lambda df, k: df.write.parquet(f"{at}/depth={k}")
    seen = lambda: spark.read.schema("root string, node string, depth int").parquet(at)
    put(roots.select(F.col("node").alias("root"), "node").distinct(), 0)
    depth = 0
    while most is None or depth < most:
        front = seen().where(F.col("depth") == depth).drop("depth")
        ahead = front.join(edge, front.node == edge.src).select("root", F.col("dst").alias("node")).distinct()
        depth += 1
        put(ahead.join(seen().select("root", "node"), ["root", "node"], "left_anti"), depth)
        if seen().where(F.col("depth") == depth).isEmpty():
            break
    return seen()


def nearest_labels(edge: DataFrame, labels: DataFrame, most: int, down: bool = True) -> DataFrame:
    """node, label, depth: the nearest label (the least on ties) that each node reaches in at most so many steps, along the edges (down) or against them.

    labels: node, label; they have depth 0, and a search ends at the first labelled node. All nodes are searched at once, from the labels back: in round
    k the nodes without a label next to one found in round k - 1 take the least label offered. Work is the edges of what is reached, whatever the number of nodes asked for.
    """
    spark, at = edge.sparkSession, new_folder(edge.sparkSession, "labels")
    back = edge.select(F.col("dst").alias("from"), F.col("src").alias("to")) if down else edge.select(F.col("src").alias("from"), F.col("dst").alias("to"))
    put = lambda df, k: df.write.parquet(f"{at}/depth={k}")
    seen = lambda: spark.read.schema("node string, label string, depth int").parquet(at)
    put(labels.groupBy("node").agg(F.min("label").alias("label")), 0)
    for depth in range(1, most + 1):
        front = seen().where(F.col("depth") == depth - 1)
        offered = front.join(back, front.node == back["from"]).groupBy(F.col("to").alias("node")).agg(F.min("label").alias("label"))
        put(offered.join(seen().select("node"), "node", "left_anti"), depth)
        if seen().where(F.col("depth") == depth).isEmpty():
            break
    return seen()


def block_labels(edge: DataFrame, nodes: DataFrame, labels: DataFrame, down: int = 6, up: int = 4, other: str = "core") -> DataFrame:
    """node, label, way: the nearest label a node drives (down), else the nearest that drives it (up), else other (none)."""
    a = nearest_labels(edge, labels, down).select("node", F.col("label").alias("_down"))
    b = nearest_labels(edge, labels, up, down=False).select("node", F.col("label").alias("_up"))
    j = nodes.select("node").join(a, "node", "left").join(b, "node", "left")
    way = F.when(F.col("_down").isNotNull(), "down").when(F.col("_up").isNotNull(), "up").otherwise("none")
    return j.select("node", F.coalesce("_down", "_up", F.lit(other)).alias("label"), way.alias("way"))


def majority(members: DataFrame, labels: DataFrame) -> DataFrame:
    """members(group, node), labels(node, label) -> group, label, votes, of: the label of most members (the least on ties)."""
    n = members.join(labels, "node").groupBy("group", "label").agg(F.count("*").alias("votes"))
    best = F.min_by(F.struct("label", "votes"), F.struct(-F.col("votes"), F.col("label")))
    return n.groupBy("group").agg(best.alias("b"), F.sum("votes").alias("of")).select("group", "b.label", "b.votes", "of")


def components(pairs: DataFrame) -> DataFrame:
    """node, rep of every node in pairs(a, b): the least node that it is connected with.

    Every round a node takes the least representative among its neighbours', then that one's own, so distances are halved and long chains take few rounds.
    Rounds are tables; the search ends when a round changes nothing.
    """
    spark, at = pairs.sparkSession, new_folder(pairs.sparkSession, "components")
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a IS NOT NULL AND b IS NOT NULL").distinct()
    both.write.parquet(f"{at}/pairs")
    both = spark.read.schema(both.schema).parquet(f"{at}/pairs")
    round_ = lambda k: spark.read.schema("node string, rep string").parquet(f"{at}/round-{k}")
    both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("rep")).write.parquet(f"{at}/round-0")
    k = 0
    while True:
        now = round_(k)
        offered = both.join(now.select(F.col("node").alias("b"), "rep"), "b").groupBy(F.col("a").alias("node")).agg(F.min("rep").alias("_near"))
        best = now.join(offered, "node").select("node", F.col("rep").alias("_was"), F.least("rep", "_near").alias("_mid"))
        far = now.select(F.col("node").alias("_mid"), F.col("rep").alias("_far"))
        after = best.join(far, "_mid").select("node", "_was", F.least("_mid", "_far").alias("rep"))
        after.write.parquet(f"{at}/round-{k + 1}")
        k += 1
        if spark.read.schema("node string, _was string, rep string").parquet(f"{at}/round-{k}").where("rep != _was").isEmpty():
            return round_(k)
