"""N-gram Jaccard join by vertical partitioning of the global n-gram order.

The global order puts rare word shingles first: shingles that are frequent in the chunks a task sees, summed and
bounded to the most frequent ones, come last by frequency, all others before them by hash. Any
order gives the same result; this one keeps common passages out of the prefixes.

1. Documents with the same set of shingles are one class; classes, not documents, are joined.
2. Two sets of similarity t share a shingle among the first n - ceil(t n) + 1 of either, so these prefixes are the
   candidates' buckets; sizes and the places of a shared shingle bound the overlap of a pair before it is made. A bitmap of the prefix hashes that occur again (fixed size) keeps the others, nearly all, from being shuffled.
3. A bucket's classes are tested against its head, and only those that stay unconnected among each other
   (linkage.py), so a group of n near copies costs about n tests.
4. Pairs are first bounded: by size, and by the Hamming distance of parity signatures (about a bit a shingle), which cannot
   exceed the symmetric difference of the sets. Neither bound can drop a link.
5. A test cuts the order into fragments: each class has one row a fragment, overlaps are counted
   fragment by fragment (array_intersect), and summed for each pair. Exact integers decide.

Texts are read again for each step rather than kept as sets, which would be larger than the texts. Classes are known by 64-bit hashes of
their shingle hashes, and shingles by 64-bit hashes; equality of two sets is equality of these.

Edge cases: null, empty and blank texts have no shingle and are linked with nothing, not even each other;
fewer words than the width are one shingle; rows that repeat a doc_id with the same text are
reported each; a null doc_id is never a component's name unless all its documents have none. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonwave.llm.common import forget, small_side, table, tidy, written
from axonwave.llm.linkage import linked_groups
from axonwave.llm.repeats import owners_for, packed_by_owner, repeated_bitmap, tested


@dataclass(frozen=True)
class JoinPlan:
    width: int = 5
    percent: int = 80
    fragments: int = 4
    bits: int = 27  #: of the bitmap of repeated prefix hashes: 16 MB
    class_bits: int = 22  #: of the bitmap of candidate classes
    frequent: int = 1 << 18  #: at most so many shingles are ordered by frequency
    local_min: int = 3  #: a shingle counts as frequent in a chunk from so many classes
    chunk: int = 4_000_000  #: shingles of a chunk
    signature: int = 1024  #: bits at least; a power of two, and as many as the set has shingles
    seen: int = 1 << 20  #: classes a task remembers, so as to skip copies


def _sets(batches, width: int):
    """(batch, row in it, sorted set) of every row."""
    from axonwave.llm.vectors import shingle_sets, slices

    for b in batches:
        for first, data, offsets in slices(b.column(1)):
            for i, s in enumerate(shingle_sets(data, offsets, width)):
                yield b, first + i, s


def _class_of(s: np.ndarray) -> tuple[int, int]:
    from axonwave.llm.vectors import mix

    with np.errstate(over="ignore"):
        n = np.uint64(len(s))
        a = mix(np.array([s.sum() + n, np.bitwise_xor.reduce(mix(s + np.uint64(0x632BE59BD9B4E019))) + n], np.uint64))
    a = a.view(np.int64)
    return int(a[0]), int(a[1])


def _parity(s: np.ndarray, least: int) -> bytes:
    """Bit i: whether an odd number of shingles falls to it. The two halves together give the signature of half the size."""
    bits = max(least, 1 << max(0, len(s) - 1).bit_length())
    return np.packbits((np.bincount((s >> np.uint64(7)).astype(np.int64) & (bits - 1), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _once(batches, plan: JoinPlan):
    """(class, set) of the classes that this task has not met before (as far as it remembers)."""
    seen: set[int] = set()
    for _, _, s in _sets(batches, plan.width):
        if len(s):
            c = _class_of(s)[0]
            if c not in seen:
                if len(seen) >= plan.seen:
                    seen.clear()
                seen.add(c)
                yield c, s


def classes(docs: DataFrame, plan: JoinPlan) -> DataFrame:
    """kind 0: doc_id, text_hash, n, f1, f2 of each row; kind 1: f1 a shingle that is frequent in a chunk, n its classes there."""
    schema = "kind int, doc_id long, n long, f1 long, f2 long, parity binary, text_hash long"

    def rows(batches):
        import pyarrow as pa

        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
        names = ["kind", "doc_id", "n", "f1", "f2", "parity", "text_hash"]
        batch = lambda cols: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        def frequent(held):
            h, n = np.unique(np.concatenate(held), return_counts=True)
            at = np.flatnonzero(n >= plan.local_min)
            zero = np.zeros(len(at), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(zero + 1, pa.int32()), pa.nulls(len(at), pa.int64()), pa.array(n[at], pa.int64()), pa.array(h[at].view(np.int64)), pa.array(zero), pa.nulls(len(at), pa.binary()), pa.nulls(len(at), pa.int64())], names)

        out, seen, held, n_held = [], set(), [], 0
        for b, i, s in _sets(batches, plan.width):
            f1, f2 = _class_of(s) if len(s) else (None, None)
            fresh = f1 is not None and f1 not in seen  # one signature of a class and task is enough
            out.append((0, b.column(0)[i].as_py(), len(s), f1, f2, _parity(s, plan.signature) if fresh else None, b.column(2)[i].as_py()))
            if len(out) >= 10_000:
                yield batch(zip(*out, strict=True))
                out = []
            if fresh:
                if len(seen) >= plan.seen:
                    seen.clear()
                seen.add(f1)
                held.append(s)
                n_held += len(s)
                if n_held >= plan.chunk:
                    yield frequent(held)
                    held, n_held = [], 0
        if out:
            yield batch(zip(*out, strict=True))
        if held:
            yield frequent(held)

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).mapInArrow(tidy(rows), schema)


def frequent_shingles(found: DataFrame, plan: JoinPlan) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingles, their counts) of at most plan.frequent shingles, the most frequent ones."""
    counts = written(found.where("kind = 1").groupBy("f1").agg(F.sum("n").alias("n")), "frequent")
    log = F.floor(F.log2(F.col("n").cast("double")) * 8)
    per = sorted(((r.k, r.c) for r in counts.groupBy(log.alias("k")).agg(F.count("*").alias("c")).collect()), reverse=True)
    least, total = None, 0
    for k, c in per:
        if total + c > plan.frequent:
            break
        least, total = k, total + c
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    t = counts.where(log >= least).toArrow()
    h, n = t.column("f1").to_numpy().view(np.uint64), t.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _split(s: np.ndarray, often: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rare shingles by hash, frequent ones by frequency): the global order."""
    if not len(often):
        return s, s[:0]
    at = np.searchsorted(often, s)
    at[at == len(often)] = 0
    hit = often[at] == s
    f = s[hit]
    return s[~hit], f[np.lexsort((f, counts[at[hit]]))]


def _prefix(s: np.ndarray, often, counts, percent: int) -> np.ndarray:
    from axonwave.llm.vectors import mix

    k = len(s) + (-len(s) * percent // 100) + 1
    rare, frequent = _split(s, often, counts)
    take = np.concatenate([rare[:k], frequent[: max(0, k - len(rare))]])
    with np.errstate(over="ignore"):  # spread again: the first by hash are all small
        return mix(take + np.uint64(0x8CB92BA72F3D8DD7))


def near_duplicates(docs: DataFrame, plan: JoinPlan = JoinPlan()) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id, group (a class of the component), text_hash for every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    texts = docs.select("doc_id", "text")
    found = written(classes(texts, plan), "classes")
    rows = found.where("kind = 0")
    known = written(rows.where("n > 0").groupBy("f1").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("parity").alias("parity")), "classes")
    order = share(frequent_shingles(found, plan))  # bounded by plan.frequent
    owners = owners_for(docs)

    def prefixes(batches):
        yield from packed_by_owner((_prefix(s, *order.value, plan.percent) for _, s in _once(batches, plan)), owners)

    blobs = texts.mapInArrow(tidy(prefixes), "owner int, hashes binary")
    again = share(repeated_bitmap(blobs, owners, plan.bits))  # 2**bits bits

    def buckets(batches):
        import pyarrow as pa

        test = tested(again.value, plan.bits)
        batch = lambda held: pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], ["bucket", "node", "n", "at"])
        held, n = [], 0
        for node, s in _once(batches, plan):
            p = _prefix(s, *order.value, plan.percent)
            at = np.flatnonzero(test(p)).astype(np.int32)
            held.append((p[at].view(np.int64), np.full(len(at), node, np.int64), np.full(len(at), len(s), np.int32), at))
            n += len(at)
            if n >= 100_000:
                yield batch(held)
                held, n = [], 0
        if n:
            yield batch(held)

    def near(x, y):
        """Sizes and places allow a link whose first common shingle is this one."""
        small, large = F.least(x("n"), y("n")).cast("long"), F.greatest(x("n"), y("n")).cast("long")
        left = F.least(x("n") - x("at"), y("n") - y("at"))
        return (100 * small >= plan.percent * large) & (left * (100 + plan.percent) >= plan.percent * (small + large))

    def differing(batches):
        """Keeps the pairs whose signatures differ in no more bits than the sets of linked classes can."""
        import pyarrow as pa

        for b in batches:
            if not len(b):
                continue
            far = np.empty(len(b), np.int64)
            for i, (x, y) in enumerate(zip(b.column(4), b.column(5), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                n = min(len(x), len(y))
                far[i] = np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, n), axis=0) ^ np.bitwise_xor.reduce(y.reshape(-1, n), axis=0)).sum(dtype=np.int64)
            size = b.column(2).to_numpy() + b.column(3).to_numpy()
            near = b.filter(pa.array(far * (100 + plan.percent) <= size * (100 - plan.percent)))
            yield pa.RecordBatch.from_arrays([near.column(0), near.column(1)], ["a", "b"])

    def allowed(pairs: DataFrame) -> DataFrame:
        side = lambda c: known.select(F.col("f1").alias(c), F.col("n").alias(f"n{c}"), F.col("parity").alias(f"parity_{c}"))
        near = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * plan.percent
        both = pairs.join(side("a"), "a").join(side("b"), "b").where(near)
        return both.select("a", "b", "na", "nb", "parity_a", "parity_b").mapInArrow(tidy(differing), "a long, b long")

    def verify(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("f1")).union(pairs.select("b")).distinct()
        wanted = written(wanted.join(known, "f1").select(F.col("f1").alias("node"), "rep"), "wanted")
        if wanted.isEmpty():
            return pairs
        slots = wanted.select(F.shiftrightunsigned("node", 64 - plan.class_bits).cast("int").alias("slot")).distinct().toArrow()
        bitmap = np.zeros((1 << plan.class_bits) // 8, np.uint8)
        at = slots.column("slot").to_numpy()
        np.bitwise_or.at(bitmap, at >> 3, (1 << (7 - (at & 7))).astype(np.uint8))
        near = share(bitmap)
        of = written(fragments(texts, near, order, plan).join(wanted, ["node"]).where("doc_id <=> rep").dropDuplicates(["node", "frag"]).select("node", "frag", "n", "part"), "fragments")
        near.destroy()
        side = lambda c: of.select(F.col("node").alias(c), "frag", F.col("n").alias(f"n{c}"), F.col("part").alias(f"part_{c}"))
        part = pairs.join(side("a"), "a").join(side("b"), ["b", "frag"]).select("a", "b", "na", "nb", F.size(F.array_intersect("part_a", "part_b")).alias("common"))
        both = part.groupBy("a", "b").agg(F.sum("common").alias("common"), F.max("na").alias("na"), F.max("nb").alias("nb"))
        return both.where(100 * F.col("common") >= plan.percent * (F.col("na") + F.col("nb") - F.col("common")))

    groups = linked_groups(texts.mapInArrow(tidy(buckets), "bucket long, node long, n int, at int"), verify, allowed, carry=("n", "at"), near=near)
    again.destroy(), order.destroy()
    named = known.join(groups.withColumnRenamed("node", "f1"), "f1", "left").withColumn("component", F.coalesce("component", "f1"))
    named = written(named.select("f1", "rep", "component"), "named")
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = written(named.join(least, "component").select("f1", "component_id", F.col("component").alias("group")), "groups")
    forget(known), forget(groups)
    return rows.join(named, "f1", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("f1").alias("class_id"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "group", "text_hash")


def one_of_each(docs: DataFrame, plan: JoinPlan = JoinPlan()) -> DataFrame:
    """docs without near duplicates: of each group the row with the smallest doc_id stays (null last; of equal ones the least hash of the text).

    Rows are told apart by doc_id and text, so a null or repeated doc_id takes nothing else along; of rows alike in both one stays.
    """
    found = written(near_duplicates(docs, plan), "near")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    stays = found.where("n_shingles > 0").groupBy("group").agg(F.min(rank).alias("s"), F.count("*").alias("of")).where("of > 1").select("group", "s")
    gone = written(found.join(stays, "group").where(rank != F.col("s")).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "gone")
    again = not found.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty()
    forget(found)
    out = docs.join(small_side(gone), docs["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("_hash")), "left_anti")
    return out.dropDuplicates(["doc_id", "text"]) if again else out


def fragments(texts: DataFrame, near, order, plan: JoinPlan) -> DataFrame:
    """node, doc_id, frag, n, part: the classes in the bitmap, one row for each fragment of the order that they occur in."""

    def rows(batches):
        import pyarrow as pa

        test, width = tested(near.value, plan.class_bits), plan.fragments - 1
        cuts = np.array([(i << 64) // width for i in range(1, width)], np.uint64)
        out, n = [], 0

        def flush():
            node, doc, frag, size, part = zip(*out, strict=True)
            flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, part)]), pa.int32()), pa.array(np.concatenate(part).view(np.int64)))
            return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(doc, pa.int64()), pa.array(frag, pa.int32()), pa.array(size, pa.int64()), flat], ["node", "doc_id", "frag", "n", "part"])

        for b, i, s in _sets(batches, plan.width):
            if len(s) and test(np.array([(c := _class_of(s)[0])], np.int64).view(np.uint64))[0]:
                rare, frequent = _split(s, *order.value)
                for f, part in enumerate([*np.split(rare, np.searchsorted(rare, cuts)), frequent]):
                    if len(part):
                        out.append((c, b.column(0)[i].as_py(), f, len(s), part))
                        n += len(part)
                if n >= 200_000:
                    yield flush()
                    out, n = [], 0
        if out:
            yield flush()

    return texts.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(rows), "node long, doc_id long, frag int, n long, part array<long>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS x FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(x[i:i+4], ' ') AS g FROM (SELECT doc_id, x, unnest(CASE WHEN len(x) = 0 THEN []::BIGINT[] WHEN len(x) < 5 THEN [1]::BIGINT[] ELSE range(1, len(x) - 3) END) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, x) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(x) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)
"""
