"""Exact dedup by distributed MSD radix partitioning.

Each text is read as a string of bytes led by its length. A round splits every open group by the
next run of characters (the radix digit), keeps the groups that still hold two rows or more, and
moves the rest of their texts on; a group is closed when its texts have ended. Rows that are alone
leave at once. Digits start short: the first round counts lengths and heads only, and moves the
text of rows whose head occurs again (or, where such heads are too many to broadcast, joins them).
They grow by a factor from round to round. Equality is decided by
the characters alone; the digest in the result is output, not a test.

Counting is a combined aggregate (one row a task for a hot group); the rows of the open groups find
their new group by a join that Spark splits where a group is hot. Each round's state is a table in
the shared folder, so a lost executor costs one round's tasks.

Edge cases: null text is empty; doc_id names a document: rows that repeat a doc_id with the same text are counted in group_size
each and share kept; null doc_ids rank below all others (keep_id is null only if the
whole group has no id). An empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axonwave.llm.common import ascii_lower, small_side, table, written


def radix_groups(rows: DataFrame, key: str, value: str, first: int = 64, factor: int = 32, most: int = 1 << 20, carry: tuple[str, ...] = ()) -> DataFrame:
    """Groups of equal values with two rows or more: key, the carried columns, keep (largest key), size.

    A digit has first characters, then factor times as many each round up to most, which bounds what
    a row of a round's aggregate holds.
    """
    digit = lambda n: F.substring("_rest", 1, n)
    open_ = rows.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_c_{c}") for c in carry], F.octet_length(value).cast("long").alias("_group"), F.col(value).alias("_rest"))
    width, done = first, []
    while True:
        d = digit(width)
        split = (
            open_.groupBy("_group", d.alias("_digit")).agg(F.count("*").alias("_size"), F.max("_key").alias("_keep"))
            .where("_size > 1").withColumn("_id", F.monotonically_increasing_id())
        )
        split = written(split, "radix-groups")
        near = small_side(split) if not done else split  # short digits: a bound on rows is one on bytes
        moved = open_.withColumn("_digit", d).join(near, ["_group", "_digit"]).select(
            "_key", *[f"_c_{c}" for c in carry], F.col("_id").alias("_group"), F.substring("_rest", width + 1, 1 << 30).alias("_rest"), "_size", "_keep")
        moved = written(moved, "radix-rows")
        done.append(moved.where("_rest = ''").select(F.col("_key").alias(key), *[F.col(f"_c_{c}").alias(c) for c in carry], F.col("_keep").alias("keep"), F.col("_size").alias("size")))
        open_ = moved.where("_rest != ''").drop("_size", "_keep")
        if open_.isEmpty():
            break
        width = min(width * factor, most)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def exact_dedup(docs: DataFrame, doc: str = "doc_id", text: str = "text", normal: Column | None = None) -> DataFrame:
    """doc, keep_id, group_size, kept, text_sha256 for every row; normal: the form in which texts are compared."""
    plain = ascii_lower(F.coalesce(F.col(text), F.lit(""))) if normal is None else normal
    rows = docs.select(F.col(doc).alias("_id"), plain.alias("_plain")).withColumn("_sha", F.sha2("_plain", 256))
    groups = radix_groups(rows, "_id", "_plain", carry=("_sha",)).select(F.col("_id").alias("_gid"), F.col("_sha").alias("_gsha"), "keep", "size").distinct()
    out = rows.select("_id", "_sha").join(groups, F.col("_id").eqNullSafe(F.col("_gid")) & (F.col("_sha") == F.col("_gsha")), "left")
    keep = F.when(F.col("size").isNotNull(), F.col("keep")).otherwise(F.col("_id"))
    return out.select(
        F.col("_id").alias(doc), keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"), F.col("_sha").alias("text_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
    doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d
"""
