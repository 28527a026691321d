"""Quality rules: counts within a document, and line frequency across documents.

Within a document: words, symbols, repeated lines and words in repeated 8-word windows, all as
array functions of one row, so that no word is shuffled. Across documents: normalised lines are
hashed, their distinct documents (by text, so that copies of one document count once) are counted
per host, lines above the limits are removed, and documents that keep too little are rejected.

DataFrame functions only. Lines are counted in two steps (host, line, text), then (host, line),
both combined before the shuffle, so a line that every document holds costs one row a task. By share
alone the lines over the limits are few (a host has at most lines-per-document / max_share of them), but
a share gets looser as a host grows; many_docs is a limit that does not. The query has the limits of its
SQL, which is by share alone; the pipeline has LIMITS.

Edge cases: null text counts as no words and fails; a null host is a host of its own; rows with
the same id and text share one verdict. Very long texts stay in one row. Extra columns are kept
away from the working columns. An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axonwave.llm.common import SPACE, ascii_lower, small_side, table, words_of, written

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class LineLimits:
    max_share: float = 0.2  #: a line is removed when more than this share of the host's documents hold it
    least_docs: int = 20  #: and at least this many of them
    keep_share: float = 0.5  #: a document with less than this share of its words left is rejected
    window: int = 8
    min_words: int = 20
    max_repeat_percent: int = 30
    many_docs: int | None = None  #: a line that so many of the host's documents hold is removed, whatever their share


#: Of the pipeline: lines of 20 documents at every size of a host, and of 5 if they are a large share of a small one.
LIMITS = LineLimits(least_docs=5, many_docs=20)


def line_hash(line: Column) -> Column:
    """Of the line in lower case (A-Z), digits as 0, white space runs as one blank, trimmed."""
    plain = F.regexp_replace(F.translate(ascii_lower(line), "123456789", "000000000"), f"[{SPACE}]+", " ")
    return F.xxhash64(F.trim(plain))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once: a name that the optimiser cannot replace by its expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(s: Column, w: int) -> Column:
    """Words in the windows whose hash occurs twice or more; s: struct(h, i) of the windows, sorted."""
    twice = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    zero = F.struct(F.lit(0).alias("n"), F.lit(-w).alias("last"))
    return F.aggregate(places, zero, lambda a, p: F.struct((a["n"] + F.least(F.lit(w), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])


def with_counts(docs: DataFrame, text: str = "text", cfg: LineLimits = LineLimits()) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    t, w = F.coalesce(F.col(text), F.lit("")), cfg.window
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    hashes = F.transform(words_of(F.col(text)), lambda x: F.xxhash64(x))
    windows = _let(hashes, lambda h: F.when(
        F.size(h) > w, F.transform(F.sequence(F.lit(0), F.size(h) - w), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(w)]))
    ).otherwise(F.array().cast("array<bigint>")))
    by_hash = lambda x: F.sort_array(F.transform(x, lambda v, i: F.struct(v.alias("h"), i.alias("i"))))
    repeated = _let(windows, lambda x: F.when(F.size(F.array_distinct(x)) < F.size(x), _let(by_hash(x), lambda s: _covered(s, w))).otherwise(0))
    out = docs.withColumns({
        "n_words": F.size(words_of(F.col(text))).cast("long"),
        "word_chars": F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated.cast("long"),
    })
    failed = (F.col("n_words") < cfg.min_words) | (100 * F.col("n_repeat_words") > cfg.max_repeat_percent * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def _lines(docs: DataFrame, text: str, doc: str, host: str) -> DataFrame:
    """One row for each line with a word: _doc, _text (hash), _host, _pos, _line (hash), _l."""
    t = F.coalesce(F.col(text), F.lit(""))
    held = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    rows = docs.select(F.col(doc).alias("_doc"), F.xxhash64(t).alias("_text"), F.col(host).alias("_host"), F.posexplode(held).alias("_pos", "_l"))
    return rows.select("_doc", "_text", "_host", "_pos", line_hash(F.col("_l")).alias("_line"), "_l")


def frequent_lines(docs: DataFrame, text: str = "text", doc: str = "doc_id", host: str = "source", cfg: LineLimits = LineLimits()) -> DataFrame:
    """_host, _line, docs, of: lines above the limits, with their number of distinct documents and the host's."""
    per = _lines(docs, text, doc, host).groupBy("_host", "_line", "_text").agg(F.lit(1).alias("one"))
    per = per.groupBy("_host", "_line").agg(F.count("*").alias("docs")).where(F.col("docs") >= cfg.least_docs)
    of = docs.select(F.col(host).alias("_of"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_text")).distinct().groupBy("_of").agg(F.count("*").alias("of"))
    over = F.col("docs") > cfg.max_share * F.col("of")
    over = over if cfg.many_docs is None else over | (F.col("docs") >= cfg.many_docs)
    return per.join(of, F.col("_host").eqNullSafe(F.col("_of"))).where(over).drop("_of")


def lost_lines(docs: DataFrame, text: str = "text", doc: str = "doc_id", host: str = "source", cfg: LineLimits = LineLimits()) -> DataFrame:
    """_doc, _text (hash), _host, _lost (words), _places (of lines) of the documents with frequent lines."""
    frequent = written(frequent_lines(docs, text, doc, host, cfg).select(F.col("_host").alias("_h"), F.col("_line").alias("_fl")), "frequent")
    return written(
        _lines(docs, text, doc, host)
        .join(frequent, F.col("_host").eqNullSafe(F.col("_h")) & (F.col("_line") == F.col("_fl")), "left_semi")
        .select("_doc", "_text", "_host", "_pos", F.size(words_of(F.col("_l"))).alias("_n")).distinct()
        .groupBy("_doc", "_text", "_host").agg(F.sum("_n").alias("_lost"), F.collect_list("_pos").alias("_places")),
        "lost")


def _with_lost(df: DataFrame, lost: DataFrame, text: str, doc: str, host: str) -> DataFrame:
    same = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    on = F.col(doc).eqNullSafe(F.col("_doc")) & (F.col("_t") == F.col("_text")) & F.col(host).eqNullSafe(F.col("_host"))
    return df.withColumn("_t", same).join(small_side(lost), on, "left").drop("_doc", "_text", "_host", "_t")


def line_quality(
    docs: DataFrame, text: str = "text", doc: str = "doc_id", host: str = "source", cfg: LineLimits = LineLimits(), lost: DataFrame | None = None
) -> DataFrame:
    """All columns of docs with the counts, base_failed, n_removed_words (in frequent lines) and kept."""
    lost = lost_lines(docs, text, doc, host, cfg) if lost is None else lost
    out = _with_lost(with_counts(docs, text, cfg), lost, text, doc, host).withColumn("n_removed_words", F.coalesce(F.col("_lost"), F.lit(0)))
    enough = (F.col("n_words") - F.col("n_removed_words")) >= cfg.keep_share * F.col("n_words")
    return out.withColumn("kept", ~F.col("base_failed") & enough).drop("_lost", "_places")


def accepted(docs: DataFrame, text: str = "text", doc: str = "doc_id", host: str = "source", cfg: LineLimits = LineLimits()) -> DataFrame:
    """The documents that are kept, with the columns of docs and without the lines above the limits.

    The verdicts are a table of their own, so that texts are judged once.
    """
    lost = lost_lines(docs, text, doc, host, cfg)
    same = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    judged = line_quality(docs.select(doc, text, host), text, doc, host, cfg, lost)
    rejected = written(judged.select(F.col(doc).alias("_rd"), same.alias("_rt"), F.col(host).alias("_rh"), F.col("kept").alias("_kept")), "verdicts").where("NOT _kept").distinct()
    out = docs.join(small_side(rejected), F.col(doc).eqNullSafe(F.col("_rd")) & (same == F.col("_rt")) & F.col(host).eqNullSafe(F.col("_rh")), "left_anti")
    out = _with_lost(out, lost, text, doc, host)
    rows = F.filter(F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: s["x"].rlike(f"[^{SPACE}]"))
    left = _let(rows, lambda r: F.transform(F.array_except(F.sequence(F.lit(0), F.size(r) - 1), F.col("_places")), lambda k: F.get(r, k)["x"]))
    return out.withColumn(text, F.when(F.col("_places").isNull(), F.col(text)).otherwise(F.array_join(left, "\n"))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t, hash(coalesce(text, '')) AS h FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT r, i, array_to_string(words[i:i+7], chr(32)) AS g FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
twice AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
rep AS (SELECT r, sum(n) AS n FROM (SELECT r, least(8, i - coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), i - 8)) AS n FROM twice) GROUP BY r),
l AS (SELECT r, h, source, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM (SELECT r, h, source, unnest(lines) AS line FROM w)),
ln AS (SELECT *, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM l),
freq AS (SELECT source, norm, count(DISTINCT h) AS docs FROM ln GROUP BY ALL),
hosts AS (SELECT source, count(DISTINCT h) AS n FROM d GROUP BY source),
over AS (SELECT f.source, f.norm FROM freq f JOIN hosts o ON f.source IS NOT DISTINCT FROM o.source WHERE docs >= 20 AND docs > 0.2 * o.n),
lost AS (SELECT r, sum(n) AS n FROM ln JOIN over o ON ln.norm = o.norm AND ln.source IS NOT DISTINCT FROM o.source GROUP BY r),
m AS (SELECT r, doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS lost FROM w LEFT JOIN rep USING (r) LEFT JOIN lost USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - lost >= 0.5 * n_words AS kept FROM m
"""
