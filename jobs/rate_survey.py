"""Rate survey: how many bits each coder would need for each recorded text, and which texts are over a budget.

    spark-submit jobs/rate_survey.py --source DOCUMENTS --out FOLDER --config jobs/rate_survey.json

A text is a recording of 8-bit samples, its UTF-8 bytes. Two coders are compared with the raw bytes: Rice codes of the
wrapped differences with the best fixed parameter of the text, and a static table for each source, trained on the other half of the
source's texts (halves by a hash of doc_id), so that no text is measured with a table that has seen it. Rates decide which coder a source gets and where the
budget fails.

Output, replaced as a whole by every run:

    documents/part=P   doc_id, lang, source, n_bytes, rice_k, rice_bits, table_millibits, best, best_bits, over_budget
    sources/part=P     lang, source, documents, n_bytes, best_bits, over_budget, coder

P is the language, "none" where it is missing. The texts are read once, by numpy within Arrow batches; what goes on is the counts of a text's bytes.
Counts are combined before they are shuffled; a source's table is at most 256 numbers. Partitions are cut by Spark's rebalancing,
so one language or source with a third of all rows is many files and tasks. Costs are whole millibits: sums do not depend on their order.
"""

from __future__ import annotations

import os
import sys
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

if not __package__:  # run as a file; workers on other machines get the packages by --py-files
    sys.path.insert(0, root := os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    os.environ["PYTHONPATH"] = os.pathsep.join([root, *filter(None, [os.environ.get("PYTHONPATH")])])

from jobs.common import command_line, config_of, log  # noqa: E402

DOCUMENTS = "doc_id long, lang string, source string, n_bytes long, rice_k int, rice_bits long, table_millibits long, best string, best_bits long, over_budget boolean"

SOURCES = "lang string, source string, documents long, n_bytes long, best_bits long, over_budget long, coder string"


@dataclass(frozen=True)
class Survey:
    limit_bits: float = 4.25  #: budget for a byte
    prefix_limit: int = 16  #: ones of a Rice prefix; beyond them the difference follows in 8 bits
    least_bytes: int = 1  #: shorter texts are within any budget


def measured(docs: DataFrame, cfg: Survey) -> DataFrame:
    """doc_id, lang, source, n_bytes, rice_k, rice_bits, counts (of the byte values that occur)."""
    limit = cfg.prefix_limit

    def many(batches):
        import numpy as np
        import pyarrow as pa

        values = pa.struct([("sym", pa.int32()), ("n", pa.int64())])
        for b in batches:
            n, ks, bits, counts = [], [], [], []
            for t in b.column(3):
                x = np.frombuffer(t.as_buffer(), np.uint8) if t.is_valid and t.as_buffer().size else np.zeros(0, np.uint8)
                d = np.diff(x).view(np.int8).astype(np.int64)  # differences modulo 256, from -128 to 127
                m = np.bincount(np.where(d >= 0, 2 * d, -2 * d - 1), minlength=256)
                of = np.arange(256)
                each = [int(m @ np.where(of >> k < limit, (of >> k) + 1 + k, limit + 8)) for k in range(9)]
                k = int(np.argmin(each))
                own = np.bincount(x, minlength=256)
                n.append(len(x))
                ks.append(k)
                bits.append(each[k] + 8 * min(len(x), 1))
                counts.append([{"sym": int(s), "n": int(own[s])} for s in np.flatnonzero(own)])
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array(n, pa.int64()), pa.array(ks, pa.int32()), pa.array(bits, pa.int64()), pa.array(counts, pa.list_(values))],
                ["doc_id", "lang", "source", "n_bytes", "rice_k", "rice_bits", "counts"])

    return docs.select("doc_id", "lang", "source", "text").mapInArrow(many, "doc_id long, lang string, source string, n_bytes long, rice_k int, rice_bits long, counts array<struct<sym:int,n:long>>")


def tables_of(rows: DataFrame) -> DataFrame:
    """source, fold, costs (millibits by byte value), rest (of a value that does not occur), trained on the texts of the other fold."""
    n = rows.select("source", "fold", F.explode("counts").alias("c")).groupBy("source", "fold", "c.sym").agg(F.sum("c.n").alias("n"))
    cost = lambda c, total: F.bround(-1000 * F.log2((c + 0.5) / (total + 128)), 0).cast("long")
    per = n.groupBy("source", "fold").agg(F.sum("n").alias("total"), F.collect_list(F.struct("sym", "n")).alias("counts"))
    costs = F.map_from_entries(F.transform("counts", lambda c: F.struct(c["sym"], cost(c["n"], F.col("total")))))
    return per.select("source", (1 - F.col("fold")).alias("fold"), costs.alias("costs"), cost(F.lit(0), F.col("total")).alias("rest"))


def half(doc: Column) -> Column:
    """0 or 1 by the upper bit of a multiplicative hash: sources are often dealt by the id's remainder."""
    return F.when(F.pmod(F.pmod(doc, F.lit(65536)) * 40503, F.lit(65536)) < 32768, 0).otherwise(1)


def rated(docs: DataFrame, cfg: Survey) -> tuple[DataFrame, DataFrame]:
    """(the columns of DOCUMENTS, the persisted counts behind them)."""
    rows = measured(docs, cfg).withColumn("fold", half(F.coalesce("doc_id", F.lit(0)))).persist()
    t = tables_of(rows).select(F.col("source").alias("_source"), F.col("fold").alias("_fold"), "costs", "rest")
    j = rows.join(t, F.col("source").eqNullSafe(F.col("_source")) & (F.col("fold") == F.col("_fold")), "left")
    rest = F.coalesce("rest", F.lit(8000))  # no text in the other half: 8 bits a byte
    one = lambda c: F.coalesce(F.element_at("costs", c["sym"]), rest)
    j = j.withColumn("table_millibits", F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c["n"] * one(c)))
    table_bits, raw = F.ceil(F.col("table_millibits") / 1000), 8 * F.col("n_bytes")
    best = F.when((raw <= F.col("rice_bits")) & (raw <= table_bits), "raw").when(F.col("rice_bits") <= table_bits, "rice").otherwise("table")
    j = j.withColumns({"best": best, "best_bits": F.least(raw, "rice_bits", table_bits).cast("long")})
    over = (F.col("n_bytes") >= cfg.least_bytes) & (F.col("best_bits") > F.lit(cfg.limit_bits) * F.col("n_bytes"))
    return j.select("doc_id", "lang", "source", "n_bytes", "rice_k", "rice_bits", "table_millibits", "best", "best_bits", over.alias("over_budget")), rows


def run(spark: SparkSession, source: str, out: str, cfg: Survey = Survey()) -> DataFrame:
    """Writes both tables and returns the first, read back."""
    part = F.when(F.coalesce("lang", F.lit("")) == "", "none").otherwise(F.col("lang")).alias("part")
    docs = spark.read.parquet(source).select("doc_id", "lang", "source", "text")
    rates, counts = rated(docs, cfg)
    try:
        log.info("read %s rows of %s", counts.count(), source)
        rates.select("*", part).hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(f"{out}/documents")
    finally:
        counts.unpersist()
    back = documents(spark, out)
    coder = F.max_by("best", F.struct("n", "best"))
    each = back.groupBy("lang", "source", "best").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("n_bytes"), F.sum("best_bits").alias("best_bits"), F.count_if("over_budget").alias("over_budget"))
    per = each.groupBy("lang", "source").agg(F.sum("n").alias("documents"), *[F.sum(c).alias(c) for c in ("n_bytes", "best_bits", "over_budget")], coder.alias("coder"))
    per.select("*", part).write.mode("overwrite").partitionBy("part").parquet(f"{out}/sources")
    log.info("wrote %s documents, %s sources to %s", back.count(), spark.read.schema(SOURCES).parquet(f"{out}/sources").count(), out)
    return back


def documents(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(DOCUMENTS).parquet(f"{out}/documents").drop("part")


def main() -> None:
    args = command_line(__doc__.splitlines()[0], ("source", "Parquet table of documents"), ("out", "folder of the output"))
    spark = SparkSession.builder.appName("rate_survey").getOrCreate()
    try:
        run(spark, args.source, args.out, config_of(spark, args.config, Survey))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
