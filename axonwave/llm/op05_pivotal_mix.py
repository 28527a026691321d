"""Mixing sources to target weights by pivotal dependent rounding.

A source's target, in words, becomes a number of copies for each of its documents: a whole part
and a fraction. Fractions are rounded in pairs: words move between a document and its partner, at random with unchanged expectation of
either, until one of the two is whole. Documents go by size, the largest first, and the partner is the pool of all smaller ones, each of which takes
its share; so a large document is settled while there are many to make up for it, and what stays open in the end is
one of the smallest. A document that is too large for the pool waits for a larger one, and where there
is none goes the way that the pool can make up for better. Where two documents are left, they are each other's partners. The words of a
source are thereby kept up to the last document.

Documents are dealt to buckets by a hash of the id, so a source with a third of all rows
is spread over all buckets. Each bucket leaves the `reserve` smallest documents of each source open (and those that wait); these meet in a reduction tree of fixed
fan-in, one table a level, until a single bucket is left, where all are settled and a last draw decides the last. Draws are hashes of ids, so reruns agree
whatever the partitioning.

Targets: sources in code point order, null last, weigh as given, repeating; a source's target is capped
at a multiple of its size and the excess is shared again by weight until none is above. The level is found
by sums over one row for each source.

Edge cases: null text has size 0 and takes 0; a null source is a source; documents of size 0 take 0; repeated rows are documents of their own;
with no words at all every target is 0; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from axonwave.llm.common import forget, fresh, small_side, table, words_of, written


@dataclass(frozen=True)
class Mix:
    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5  #: of the words of all documents
    cap: float = 2.0  #: of a source's words, and of a document's
    seed: int = 7
    bucket_rows: int = 20_000
    fan_in: int = 32
    reserve: int = 64


def targets(sizes: DataFrame, cfg: Mix = Mix()) -> DataFrame:
    """sizes(source, size) -> source, source_size, target; one row for each source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.col("source").asc_nulls_last()
    ranged = written(per.orderBy(order).withColumn("part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # rows: partitions
    parts = ranged.groupBy("part").agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1 + F.col("first")
    weight = F.element_at(F.array(*[F.lit(w) for w in cfg.weights]), (F.pmod(rank, F.lit(len(cfg.weights))) + 1).cast("int"))
    per = written(ranged.join(F.broadcast(parts), "part").withColumn("weight", weight.cast("double")).drop("part", "first"), "sources")
    forget(ranged)
    total = cfg.share * (per.agg(F.sum("source_size")).first()[0] or 0)
    level, before = 0.0, -1
    while True:
        full = cfg.cap * F.col("source_size") < F.lit(level) * F.col("weight")
        r = per.agg(F.sum(F.when(full, F.col("source_size"))).alias("fixed"), F.sum(F.when(~full, F.col("weight"))).alias("weight"), F.count(F.when(full, 1)).alias("n")).first()
        if r.n == before or not r.weight:
            break
        before, level = r.n, (total - cfg.cap * (r.fixed or 0)) / r.weight
    return per.select("source", "source_size", F.least(cfg.cap * F.col("source_size"), F.lit(level) * F.col("weight")).alias("target"))


def _mixed(a: int) -> float:
    """A hash as a number from 0 to 1 (without 1)."""
    m = (1 << 64) - 1
    a &= m
    a = (a ^ (a >> 30)) * 0xBF58476D1CE4E5B9 & m
    a = (a ^ (a >> 27)) * 0x94D049BB133111EB & m
    return ((a ^ (a >> 31)) >> 11) / (1 << 53)


def pivot(items: list[list]) -> tuple[list[list], list | None]:
    """items [p, size, hash, ...] in order -> those that became whole, and the one left open."""
    done, open_ = [], None
    for b in items:
        if b[0] <= 0.0 or b[0] >= 1.0:
            done.append(b)
            continue
        if open_ is None:
            open_ = b
            continue
        a = open_
        to_a, to_b = min((1 - a[0]) * a[1], b[0] * b[1]), min(a[0] * a[1], (1 - b[0]) * b[1])
        if _mixed(a[2] * 3 + b[2]) * (to_a + to_b) < to_b:
            gains, gives, moved = a, b, to_a
        else:
            gains, gives, moved = b, a, to_b
        whole = moved == (1 - gains[0]) * gains[1]
        emptied = moved == gives[0] * gives[1]
        gains[0] = 1.0 if whole else min(1.0, gains[0] + moved / gains[1])
        gives[0] = 0.0 if emptied else max(0.0, gives[0] - moved / gives[1])
        open_ = None
        for x in (a, b):
            if 0.0 < x[0] < 1.0:
                open_ = x
            else:
                done.append(x)
    return done, open_


def _forced(p: float, size: float, mass: float, free: float, u: int, pool):
    """(whether a document too large for a draw is taken, the pool's fractions then): the way that its pool can make up for better."""
    short = max(0.0, (1 - p) * size - mass), max(0.0, p * size - free)
    up = short[0] < short[1] or short[0] == short[1] and _mixed(u) < p
    if up:
        return True, pool * (1 - min(1.0, (1 - p) * size / mass)) if mass else pool
    return False, pool + (1 - pool) * min(1.0, p * size / free) if free else pool


def _settled(p: np.ndarray, size: np.ndarray, u: np.ndarray, reserve: int) -> np.ndarray:
    """p after the documents, largest first, are settled against the pool of all smaller open ones; reserve documents stay in the pool."""
    p, part = p.copy(), 0.5 if reserve else 1.0  # of the pool's room that one document may use
    open_ = np.flatnonzero((p > 0) & (p < 1))
    if len(open_) > 1 and (p[open_] == p[open_[0]]).all():  # as dealt: one number for the whole pool
        x, rest = float(p[open_[0]]), np.append(np.cumsum(size[open_][::-1])[::-1], 0).tolist()
        waits, at = [], 0
        while at < len(open_) - max(reserve, 1) and 0 < x < 1:
            i, of = open_[at], rest[at + 1]
            s = float(size[i])
            if s * max(x, 1 - x) > part * of * min(x, 1 - x):
                if reserve:
                    waits.append((i, x))
                else:
                    up, x = _forced(x, s, x * of, of - x * of, int(u[i]), x)
                    p[i] = float(up)
            else:
                up = _mixed(int(u[i])) < x
                x, p[i] = x + (x - up) * s / of, float(up)
            at += 1
        p[open_[at:]] = x
        for i, was in waits:
            p[i] = was
        return p
    for k in range(len(open_) - max(reserve, 1)):
        i, pool = open_[k], open_[k + 1 :]
        room = np.minimum(p[pool], 1 - p[pool])
        of = float(room @ size[pool])
        x, s = float(p[i]), float(size[i])
        if 0 < x < 1 and s * max(x, 1 - x) <= part * of:
            up = _mixed(int(u[i])) < x
            p[pool] = np.clip(p[pool] + (x - up) * s / of * room, 0.0, 1.0)
            p[i] = float(up)
        elif 0 < x < 1 and not reserve:
            mass = float(p[pool] @ size[pool])
            up, p[pool] = _forced(x, s, mass, float(size[pool].sum()) - mass, int(u[i]), p[pool])
            p[i] = float(up)
    return p


def _round(reserve: int):
    """Pivotal rounding of one group, source by source. reserve: documents left open; 0: one at most, by pairs."""

    def rounded(pdf):
        pdf = pdf.sort_values(["size", "u", "doc"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        p = pdf["p"].to_numpy(dtype="float64").copy()
        size, u = pdf["size"].to_numpy(dtype="float64"), pdf["u"].to_numpy()
        for own in pdf.groupby("source", dropna=False, sort=False).indices.values():
            own = np.sort(own)
            p[own] = _settled(p[own], size[own], u[own], reserve)
            if not reserve:
                left = [[p[i], size[i], int(u[i]), i] for i in own if 0 < p[i] < 1]
                done, open_ = pivot(left)
                for r in done + ([open_] if open_ else []):
                    p[r[3]] = r[0]
        return pdf.assign(p=p)

    return rounded


def mixed(docs: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", cfg: Mix = Mix()) -> DataFrame:
    """doc, source, size, source_size, target, taken (words), copies, text_hash for every row."""
    spark = docs.sparkSession
    thin = written(docs.select(F.col(doc).alias("doc"), F.col(source).alias("source"), F.size(words_of(F.col(text))).cast("long").alias("size"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash")), "sizes")
    goal = written(targets(thin, cfg), "targets")
    g = small_side(goal.withColumnRenamed("source", "_s"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = thin.join(g, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("base", F.when(F.col("size") > 0, F.floor(ratio)).otherwise(0))
    rows = rows.withColumns({
        "p": F.when(F.col("size") > 0, ratio - F.col("base")).otherwise(0.0),
        "u": F.xxhash64(F.coalesce("doc", F.lit(-1)), "text_hash", F.lit(cfg.seed)),
    })
    n, n_sources = thin.count(), goal.count()
    buckets, lanes = max(1, -(-n // cfg.bucket_rows)), max(1, -(-n_sources // 100))
    rows = rows.withColumns({"bucket": F.pmod(F.col("u"), F.lit(buckets)), "lane": F.pmod(F.hash("source"), F.lit(lanes))})
    schema = rows.schema
    decided = []
    is_open = (F.col("p") > 0) & (F.col("p") < 1)
    rows = written(rows.groupBy("bucket").applyInPandas(_round(cfg.reserve if buckets > 1 else 0), schema), "mix")
    while buckets > 1:
        decided.append(rows.where(~is_open))
        buckets = -(-buckets // cfg.fan_in)
        up = rows.where(is_open).withColumn("bucket", F.floor(F.col("bucket") / cfg.fan_in))
        rows = written(up.groupBy("bucket", "lane").applyInPandas(_round(cfg.reserve if buckets > 1 else 0), schema), "mix")
    last = F.when(is_open, (F.pmod(F.xxhash64("u", F.lit(cfg.seed + 1)), F.lit(1 << 30)) < F.col("p") * (1 << 30)).cast("double")).otherwise(F.col("p"))
    out = rows.withColumn("p", last)
    for x in decided:
        out = out.unionByName(x)
    copies = (F.col("base") + F.round("p")).cast("long")
    return out.select(F.col("doc").alias(doc), "source", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "text_hash")


def mix_of(docs: DataFrame, cfg: Mix = Mix()) -> DataFrame:
    """The rows of docs(doc_id, text, source, ...), each as often as the mix takes it; rows alike in these three count together."""
    key = fresh(docs, "_key"), fresh(docs, "_copies")
    taken = mixed(docs, cfg=cfg).groupBy("doc_id", "source", "text_hash").agg(F.sum("copies").alias(key[1]), F.count("*").alias("rows"))
    taken = written(taken, "taken")
    alike = not taken.where("rows > 1").isEmpty()
    taken = taken.where(F.col(key[1]) > 0).select(F.struct("doc_id", "source", "text_hash").alias(key[0]), key[1])
    rows = docs.dropDuplicates(["doc_id", "text", "source"]) if alike else docs
    own = F.struct(rows["doc_id"], rows["source"], F.xxhash64(F.coalesce(rows["text"], F.lit(""))))
    out = rows.join(small_side(taken, 20_000), own.eqNullSafe(F.col(key[0])))
    return out.withColumn(key[1], F.explode(F.sequence(F.lit(1), F.col(key[1]).cast("int")))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
