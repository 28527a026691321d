"""Queries that write the given tables in the engine's file formats and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from axonwave.plans.samples import SQL, samples, table
from axonwave.plans.signal_queries import N
from axonwave.sources import reports, stimulus
from axonwave.sources.folders import new_folder


def frame_files(spark, d):
    """Recorded frames as files, read back: frames that all channels have, by channel."""
    x, at = samples(spark, d), new_folder(spark, "frames")
    stimulus.write_frames(x, at, N, part=512)
    y = stimulus.read_frames(spark, at, N)
    return y.groupBy("ch").agg(F.count("*").alias("n"), F.sum("code").alias("total"), F.sum(F.col("code") * (F.col("frame") % 97)).alias("mixed"), F.max("frame").alias("last"))


def summary_report(spark, d):
    """A report of every return flag's line items against budgets, as markdown written and read back, line by line."""
    l = table(spark, d, "lineitem")
    m = l.groupBy("l_returnflag").agg(F.avg("l_quantity").alias("quantity"), F.max("l_discount").alias("discount"), F.count("*").cast("double").alias("lines"), F.avg("l_tax").alias("tax"))
    m = m.select(F.col("l_returnflag").alias("run"), F.posexplode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in ("quantity", "discount", "lines", "tax")])).alias("i", "m")).select("run", "m.name", "m.value")
    # budgets: a share of what the whole table has
    b = l.agg(F.avg("l_quantity").alias("q"), F.max("l_discount").alias("x"), F.count("*").alias("n"))
    budget = lambda name, lim, cmp, unit: F.struct(F.lit(name).alias("name"), lim.alias("lim"), F.lit(cmp).alias("cmp"), F.lit(unit).alias("unit"))
    limits = [budget("quantity", F.col("q"), "<=", "pcs"), budget("discount", F.col("x") - 0.001, "<=", ""), budget("lines", F.col("n") / 3.0, ">=", "rows")]
    b = b.select(F.inline(F.array(*limits)))
    at = new_folder(spark, "summary")
    reports.write_summary(reports.scored(m, b), at)
    return spark.read.schema("value string, run string").text(f"{at}/markdown").select("run", F.col("value").alias("text")).groupBy("run", "text").agg(F.count("*").alias("n"))


QUERIES = {
    "frame_files": (frame_files, f"WITH {SQL}, w AS (SELECT * FROM s QUALIFY count(*) OVER (PARTITION BY frame) = 8) SELECT ch, count(*) AS n, sum(code)::BIGINT AS total, sum(code * (frame % 97))::BIGINT AS mixed, max(frame) AS last FROM w GROUP BY ch"),
    "summary_report": (summary_report, """WITH m AS (SELECT l_returnflag AS run, unnest(['quantity', 'discount', 'lines', 'tax']) AS name, unnest([avg(l_quantity), max(l_discount), count(*)::DOUBLE, avg(l_tax)]) AS value FROM lineitem GROUP BY l_returnflag),
        b AS (SELECT unnest(['quantity', 'discount', 'lines']) AS name, unnest([avg(l_quantity), max(l_discount) - 0.001, count(*) / 3.0::DOUBLE]) AS lim, unnest(['<=', '<=', '>=']) AS cmp, unnest(['pcs', '', 'rows']) AS unit FROM lineitem),
        s AS (SELECT run, m.name, value, lim, coalesce(unit, '') AS unit, CASE WHEN value IS NULL THEN 'N/A' WHEN lim IS NULL THEN 'INFO' WHEN (cmp = '>=' AND value >= lim) OR (cmp = '<=' AND value <= lim) THEN 'PASS' ELSE 'FAIL' END AS status FROM m LEFT JOIN b ON m.name = b.name),
        t AS (SELECT run, '| ' || concat_ws(' | ', name, coalesce(printf('%.3f', value), '-'), coalesce(printf('%.3f', lim), '-'), unit, status) || ' |' AS text FROM s
            UNION ALL SELECT run, unnest(['# ' || run, count(*) FILTER (status = 'FAIL') || ' of ' || count(*) || ' failed', '| metric | value | limit | unit | status |', '|-|-|-|-|-|']) FROM s GROUP BY run)
        SELECT run, text, count(*) AS n FROM t GROUP BY ALL"""),
}
