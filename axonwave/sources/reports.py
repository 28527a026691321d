"""Reports of metrics against budgets: as markdown, CSV and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def scored(metrics: DataFrame, budgets: DataFrame) -> DataFrame:
    """run, name, value, lim, unit, status of metrics(run, name, value) against budgets(name, lim, cmp, unit): cmp is '<=' or '>='. Without a budget INFO, without a value N/A."""
    ok = F.when(F.col("cmp") == ">=", F.col("value") >= F.col("lim")).otherwise(F.col("value") <= F.col("lim"))
    status = F.when(F.col("value").isNull(), "N/A").when(F.col("lim").isNull(), "INFO").when(ok, "PASS").otherwise("FAIL")
    return metrics.join(budgets, "name", "left").select("run", "name", "value", "lim", "unit", status.alias("status"))


def summary_lines(scores: DataFrame, digits: int = 3) -> DataFrame:
    """run, line, text: a markdown table for each run, by name, with a heading and a count of failures."""
    number = lambda c: F.when(c.isNull(), "-").otherwise(F.format_string(f"%.{digits}f", c))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", "name", number(F.col("value")), number(F.col("lim")), F.coalesce("unit", F.lit("")), "status"), F.lit(" |"))
    body = scores.select("run", (F.row_number().over(Window.partitionBy("run").orderBy("name")) + 3).alias("line"), row.alias("text"))
    head = scores.groupBy("run").agg(F.count_if(F.col("status") == "FAIL").alias("bad"), F.count("*").alias("n"))
    top = F.array(F.concat(F.lit("# "), "run"), F.concat(F.col("bad").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" failed")), F.lit("| metric | value | limit | unit | status |"), F.lit("|-|-|-|-|-|"))
    return head.select("run", F.posexplode(top).alias("line", "text")).unionByName(body)


def write_summary(scores: DataFrame, path: str) -> None:
    """markdown/run=..., csv/run=... and json of the scores. Lines of a run are one file, in order: a report is as long as its metrics."""
    lines = summary_lines(scores)
    lines.repartition("run").sortWithinPartitions("run", "line").select("run", F.col("text").alias("value")).write.mode("overwrite").partitionBy("run").text(f"{path}/markdown")
    scores.repartition("run").sortWithinPartitions("run", "name").write.mode("overwrite").partitionBy("run").option("header", True).csv(f"{path}/csv")
    scores.write.mode("overwrite").json(f"{path}/json")
