"""Filter interaction audit by depth-first execution of a permutation trie.

Every order of the filters is a path of a trie; two prefixes with the same set of filters leave the
same documents, so a prefix state is named by its set alone and executed once (2**n states and
n * 2**(n - 1) edges in place of n! paths). The trie is walked depth first. A state is a DataFrame of its
survivors, persisted while a state below it is still to be made: at most n at a time. One aggregate a
state counts, by part, its survivors and what each filter that has not been applied removes from them; its rows
(parts, not documents) are written. The paths are then read off these tables by a join with
the n! * n steps.

Texts are read once: the failure conditions of a document become the bits of a number, and survivors
are rows of part, bits and labels. All counts are combined before they are shuffled, so a part with a third of all rows costs
one row a task. Verdicts are a table in the shared folder: lost executors cost the partitions that they kept.

Copies: a text's digest (SHA-256) and length meet its smallest doc_id, for digests that occur twice or more; hot
digests are split by the adaptive join.

Edge cases: null text is empty; a null part is the empty string, with which it is one part; a condition that is null does
not fail; a null doc_id has no label, fails no comparison with smaller ids and is no smaller id; repeated rows count each, and a doc_id
does not make its own repetition a copy; a doc_id with several labels is good (toxic) if any says so; an empty table gives an empty
table; columns of any other name are not read, and none of the names used inside can clash with them.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from axonwave.llm.common import small_side, table, words_of, written

#: Orders grow as n!; a report of more filters than this is of no use to a reader.
MOST_FILTERS = 7


def text_filters(text: str = "text") -> dict[str, Column]:
    """The failure conditions A to D of a text column; E is the copy condition of `verdicts`."""
    plain = F.coalesce(F.col(text), F.lit(""))
    words = words_of(F.col(text))
    capitals = F.length(plain) - F.length(F.translate(plain, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * capitals > 5 * F.length(plain),
        "D": plain.rlike(r"[#$%&*|]"),
    }


def verdicts(docs: DataFrame, filters: Mapping[str, Column], labels: DataFrame | None = None, copies: str | None = "E", doc: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """part, fails (bit i: the i-th filter's condition), good, toxic of each document; the copy filter's bit is the last."""
    bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.coalesce(c, F.lit(False)), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(filters.values())], F.lit(0))
    plain = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), bits.alias("fails"),
        *([F.unhex(F.sha2(plain, 256)).alias("digest"), F.octet_length(plain).alias("n")] if copies else []))
    if copies:
        rows = written(rows, "audit-rows")
        first = rows.groupBy("digest", "n").agg(F.min("id").alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
        first = small_side(written(first, "audit-copies"))
        copy = F.when(F.col("first") < F.col("id"), F.lit(1 << len(filters))).otherwise(F.lit(0))
        rows = rows.join(first, ["digest", "n"], "left").select("id", "part", F.col("fails").bitwiseOR(copy).alias("fails"))
    if labels is None:
        return rows.select("part", "fails", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    is_one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    known = labels.where(F.col(doc).isNotNull()).groupBy(F.col(doc).alias("id")).agg(is_one("quality"), is_one("toxic"))
    return rows.join(known, "id", "left").select("part", "fails", F.coalesce("quality", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def trie_counts(rows: DataFrame, n: int) -> DataFrame:
    """part, state (bits of the filters applied), kept, edges(array by filter of removed, good_lost, toxic_lost; null where applied).

    rows: part, fails, good, toxic. Depth first; a state that was reached by another order is not executed again.
    """
    spark = rows.sparkSession
    tables, seen, slots = [], set(), spark.sparkContext.defaultParallelism

    def visit(state: int, survivors: DataFrame) -> None:
        seen.add(state)
        ahead = [i for i in range(n) if not state >> i & 1]
        below = [i for i in ahead if state | 1 << i not in seen]
        if below:
            survivors = survivors.persist()
        fails = lambda i: F.col("fails").bitwiseAND(F.lit(1 << i)) != 0
        edge = lambda i: F.struct(F.count_if(fails(i)).alias("removed"), F.count_if(fails(i) & F.col("good")).alias("good_lost"), F.count_if(fails(i) & F.col("toxic")).alias("toxic_lost"))
        none = F.lit(None).cast("struct<removed:bigint,good_lost:bigint,toxic_lost:bigint>")
        counts = survivors.groupBy("part").agg(F.count("*").alias("kept"), F.array(*[edge(i) if i in ahead else none for i in range(n)]).alias("edges"))
        counts = counts.select("part", F.lit(state).alias("state"), "kept", "edges").coalesce(slots)  # sums already: no file for each shuffle partition
        tables.append(written(counts, "audit-state"))
        for i in below:
            if state | 1 << i not in seen:
                visit(state | 1 << i, survivors.where(~fails(i)))
        if below:
            survivors.unpersist()

    visit(0, rows)
    return spark.read.schema(tables[0].schema).parquet(*[t._axonwave_path for t in tables])


def audit(docs: DataFrame, filters: Mapping[str, Column], labels: DataFrame | None = None, copies: str | None = "E", doc: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row for each part, order of the filters and step.

    filters: one-letter names and failure conditions over docs. copies: the letter of the filter that
    fails a text which a smaller id has too, or None. labels: doc, quality, toxic.
    """
    letters = "".join(filters) + (copies or "")
    n = len(letters)
    if not 0 < n <= MOST_FILTERS or len(set(letters)) < n:
        raise ValueError(f"1 to {MOST_FILTERS} filters of different one-letter names are needed")
    rows = written(verdicts(docs, filters, labels, copies, doc, text, part), "audit-verdicts")
    counts = trie_counts(rows, n)
    steps = []
    for order in permutations(range(n)):
        state = 0
        for step, i in enumerate(order, 1):
            steps.append(("".join(letters[j] for j in order), step, i, state, state | 1 << i, (1 << n) - 1 - (1 << i)))
            state |= 1 << i
    # The trie is a constant of n! * n rows, dealt to each part without a join.
    trie = F.from_json(
        F.lit(json.dumps([dict(zip(("filter_order", "step", "i", "before", "after", "others"), s, strict=True)) for s in steps])),
        "array<struct<filter_order:string,step:int,i:int,before:int,after:int,others:int>>")
    # A part's states fit one row: 2**n of them. A state without survivors of a part has no row and counts 0.
    states = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("state", F.struct("kept", "edges")))).alias("of"))
    at = lambda state, what: F.element_at("of", state)[what]
    edge = lambda state, i, what: F.coalesce(F.get(at(state, "edges"), i)[what], F.lit(0))
    s = states.select("part", "of", F.explode(trie).alias("s")).select("part", "of", "s.*")
    shapley = F.sum("removed").over(Window.partitionBy("part", "i"))
    out = s.select(
        "part", "filter_order", "step", "i", F.coalesce(at(F.col("after"), "kept"), F.lit(0)).alias("kept"), edge(F.col("before"), F.col("i"), "removed").alias("removed"),
        edge(F.lit(0), F.col("i"), "removed").alias("fail"), edge(F.col("others"), F.col("i"), "removed").alias("unique_fails"),
        edge(F.col("before"), F.col("i"), "good_lost").alias("good_lost"), edge(F.col("before"), F.col("i"), "toxic_lost").alias("toxic_lost"))
    return out.select("part", "filter_order", "step", "kept", "removed", (F.col("fail") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", shapley.alias("shapley"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), text_filters(), table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CAST(len(w) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INT)
    + 4 * CAST(100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 5 * length(t) AS INT)
    + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
    + 16 * CAST(coalesce(min(d.doc_id) OVER (PARTITION BY t) < d.doc_id, false) AS INT) AS fails
    FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails),
b(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.letter || b2.letter || c.letter || d2.letter || e.letter AS filter_order, [a.bit, b2.bit, c.bit, d2.bit, e.bit] AS bits
    FROM b a, b b2, b c, b d2, b e WHERE a.bit | b2.bit | c.bit | d2.bit | e.bit = 31),
s AS (SELECT filter_order, CAST(step AS INT) AS step, bits[step] AS bit, list_sum(bits[1:step - 1]) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, bit,
    sum(CASE WHEN fails & (coalesce(before, 0)::BIGINT | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN fails & coalesce(before, 0)::BIGINT = 0 AND fails & bit > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails & coalesce(before, 0)::BIGINT > 0 AND fails & bit > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails & coalesce(before, 0)::BIGINT = 0 AND fails & bit > 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN fails & coalesce(before, 0)::BIGINT = 0 AND fails & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM g, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
    CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""
