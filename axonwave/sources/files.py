"""Readers and writers of recordings, captures, vectors and reports."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """path, fs, i, x of 16-bit mono files; anything else is an error. One task reads a file."""

    def many(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                with wave.open(io.BytesIO(bytes(r.content))) as w:
                    if w.getsampwidth() != 2 or w.getnchannels() != 1:
                        raise ValueError(f"{r.path}: only 16-bit mono is read")
                    x = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.int64)
                    yield pd.DataFrame({"path": r.path, "fs": w.getframerate(), "i": np.arange(len(x)), "x": x})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(many, "path string, fs int, i long, x long")


def as_codes(x: DataFrame, bits: int = 10) -> DataFrame:
    """path, i, x, code: the step is found from the gaps of each file's values and must give one code for each value."""
    u = x.select("path", "x").distinct()
    w = Window.partitionBy("path").orderBy("x")
    g = u.withColumn("gap", F.col("x") - F.lag("x").over(w)).where("gap IS NOT NULL")
    near = g.join(g.groupBy("path").agg((1.5 * F.median("gap")).alias("m")), "path").where("gap < m").groupBy("path").agg(F.avg("gap").alias("mean"))
    span = u.groupBy("path").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("levels"))
    s = span.join(near, "path", "left").withColumn("n", F.bround((F.col("hi") - F.col("lo")) / F.col("mean"), 0))
    s = s.withColumn("step", F.when(F.col("levels") > 1, (F.col("hi") - F.col("lo")) / F.greatest(F.col("n"), F.lit(1))))
    rel = F.bround((F.col("x") - F.col("lo")) / F.col("step"), 0).cast("long")
    centre = F.floor(((1 << bits) - 1 - F.col("n")) / 2).cast("long")
    code = F.when(F.col("step").isNull(), 1 << (bits - 1)).otherwise(rel + centre)
    lut = u.join(s, "path").select("path", "x", code.alias("code"), "levels", "n")
    bad = lut.where((F.col("n") >= 1 << bits)).limit(1).count() or lut.groupBy("path", "code").agg(F.count_distinct("x").alias("c"), F.first("levels").alias("l")).where("c > 1 AND l > 1").limit(1).count()
    if bad:
        raise ValueError("values do not lie on a grid of the given bits")
    return x.join(lut.select("path", "x", "code"), ["path", "x"]).select("path", "i", "x", "code")


def stacked(codes: DataFrame, n: int, first: int = 0) -> DataFrame:
    """stream, ch, frame, code of n files in order of their names, cut to the shortest."""
    files = codes.groupBy("path").agg((F.max("i") + 1).alias("len"))
    files = files.withColumn("ch", F.row_number().over(Window.orderBy("path")) - 1 - first).where((F.col("ch") >= 0) & (F.col("ch") < n))  # rows: files
    least = files.agg(F.min("len").alias("least"))
    out = codes.join(F.broadcast(files.select("path", "ch")), "path").join(F.broadcast(least)).where("i < least")
    return out.select(F.lit(0).cast("long").alias("stream"), F.col("ch").cast("int"), F.col("i").alias("frame"), "code")


def read_capture(spark: SparkSession, path: str) -> DataFrame:
    """path, pos, kind (B byte, A abort, O overflow), v, last of each capture file. Tokens: XX, XXL, XX L, A or ABORT, O or OVF; # starts a comment."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n")).alias("line", "text"))
    tok = lines.select("path", "line", F.posexplode(F.filter(F.split(F.trim(F.regexp_replace("text", "#.*", "")), r"\s+"), lambda t: t != "")).alias("i", "t"))
    w = Window.partitionBy("path").orderBy("line", "i")  # a file is one capture of one device
    tok = tok.select("path", F.upper("t").alias("t"), "line", "i").withColumn("next", F.lead("t").over(w)).where("t != 'L'")
    kind = F.when(F.col("t").isin("A", "ABORT"), "A").when(F.col("t").isin("O", "OVF"), "O").otherwise("B")
    byte = F.conv(F.regexp_replace("t", "L$", ""), 16, 10).cast("int")
    return tok.select("path", (F.row_number().over(w) - 1).cast("long").alias("pos"), kind.alias("kind"), F.when(kind == "B", byte).alias("v"), ((kind == "B") & (F.col("t").endswith("L") | (F.coalesce("next", F.lit("")) == "L"))).alias("last"))


def write_capture(tokens: DataFrame, path: str) -> None:
    t = F.when(F.col("kind") == "A", "A").when(F.col("kind") == "O", "OVF").otherwise(F.concat(F.lpad(F.hex("v"), 2, "0"), F.when(F.col("last"), "L").otherwise("")))
    tokens.orderBy("pos").select(t.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """path, pos, v, last of each file's hexadecimal words with bit 8 as the last flag; 200 ends the list."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", r"\s+")).alias("pos", "t")).where("t != ''")
    words = lines.select("path", "pos", F.conv("t", 16, 10).cast("int").alias("w"))
    end = words.where("w = 512").groupBy("path").agg(F.min("pos").alias("end"))
    return words.join(end, "path", "left").where("end IS NULL OR pos < end").select("path", F.col("pos").cast("long"), F.col("w").bitwiseAND(255).alias("v"), (F.col("w") >= 256).alias("last"))


def write_vectors(packets: DataFrame, path: str, most: int = 8192) -> None:
    """Packets as words, one a line, with the last flag and the end mark."""
    h = F.hex("bytes")
    b = packets.select("pkt", F.length("bytes").alias("n"), F.posexplode(F.transform(F.sequence(F.lit(0), F.length("bytes") - 1), lambda i: F.substr(h, 2 * i + 1, F.lit(2)))).alias("i", "x"))
    if b.count() >= most:
        raise ValueError(f"{most} words or more")
    words = b.select("pkt", "i", F.when(F.col("i") == F.col("n") - 1, F.concat(F.lit("1"), "x")).otherwise(F.concat(F.lit("0"), "x")).alias("value"))
    end = packets.sparkSession.createDataFrame([(1 << 60, 0, "200")], "pkt long, i int, value string")
    words.unionByName(end).orderBy("pkt", "i").select(F.lower("value").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def synthetic(spark: SparkSession, streams: int, n_ch: int, frames: int, seed: int = 1) -> DataFrame:
    """Random-walk background, noise and two-phase spikes; one task makes a stream, so any number of streams is parallel."""

    def many(batches):
        for pdf in batches:
            for s in pdf.id:
                rng = np.random.default_rng([seed, int(s)])
                x = 512 + np.cumsum(rng.normal(0, 2, (frames, n_ch)), axis=0) * 0.5 + rng.normal(0, 4, (frames, n_ch))
                for c in range(n_ch):
                    for t in np.flatnonzero(rng.random(frames) < 1e-3):
                        shape = np.concatenate([-80 * np.hanning(10), 40 * np.hanning(14)])[: frames - t]
                        x[t : t + len(shape), c] += shape
                x = np.clip(np.rint(x), 0, 1023).astype(np.int64)
                yield pd.DataFrame({"stream": s, "ch": np.tile(np.arange(n_ch), frames), "frame": np.repeat(np.arange(frames), n_ch), "code": x.reshape(-1)})

    return spark.range(streams).mapInPandas(many, "stream long, ch int, frame long, code long")


def read_junit(spark: SparkSession, path: str) -> DataFrame:
    """name, seconds, failed of every test case of JUnit files."""
    t = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)(<testcase\b.*?(?:/>|</testcase>))"), 1)).alias("c"))
    return t.select(F.regexp_extract("c", r'\bname="([^"]*)"', 1).alias("name"), F.regexp_extract("c", r'\btime="([^"]*)"', 1).try_cast("double").alias("seconds"), F.col("c").rlike("<(failure|error)").alias("failed"))


def read_netlist(spark: SparkSession, path: str) -> DataFrame:
    """inst, cell, pin, net of every connected pin of a structural netlist."""
    t = spark.read.text(path, wholetext=True).select(F.explode(F.split(F.regexp_replace("value", r"//[^\n]*|(?s)/\*.*?\*/", ""), ";")).alias("s"))
    inst = t.select(F.regexp_extract("s", r"(?s)^\s*(\w+)\s+(\S+)\s*\((.*)\)\s*$", 1).alias("cell"), F.regexp_extract("s", r"(?s)^\s*(\w+)\s+(\S+)\s*\((.*)\)\s*$", 2).alias("inst"), "s").where("cell != '' AND cell NOT IN ('module', 'assign', 'wire')")
    pins = inst.select("inst", "cell", F.explode(F.regexp_extract_all("s", F.lit(r"(\.\w+\s*\(\s*[^()\s]*\s*\))"), 1)).alias("p"))
    return pins.select("inst", "cell", F.regexp_extract("p", r"\.(\w+)", 1).alias("pin"), F.regexp_extract("p", r"\(\s*([^()\s]*)", 1).alias("net")).where("net != ''")


def read_vcd(spark: SparkSession, path: str) -> DataFrame:
    """path, t, i (line), net, v of single-bit changes of value change dumps (x and z as null)."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n")).alias("i", "s"))
    names = lines.select("path", F.regexp_extract("s", r"^\$var\s+\w+\s+1\s+(\S+)\s+(\S+)", 1).alias("id"), F.regexp_extract("s", r"^\$var\s+\w+\s+1\s+(\S+)\s+(\S+)", 2).alias("net")).where("id != ''")
    w = Window.partitionBy("path").orderBy("i")  # a dump is one sequence of times
    at = F.last(F.when(F.col("s").startswith("#"), F.expr("try_cast(substring(s, 2) AS bigint)")), True).over(w)
    c = lines.withColumn("t", F.coalesce(at, F.lit(0))).where(F.col("s").rlike("^[01xzXZ]\\S+$"))
    c = c.select("path", "t", "i", F.expr("substring(s, 2)").alias("id"), F.expr("try_cast(substring(s, 1, 1) AS int)").alias("v"))
    return c.join(F.broadcast(names), ["path", "id"]).select("path", "t", "i", "net", "v")


def write_tables(tables: list[list[int]], spark: SparkSession, path: str) -> None:
    """Cumulative tables as JSON, one row a context."""
    spark.createDataFrame([(k, t) for k, t in enumerate(tables)], "ctx int, cdf array<long>").coalesce(1).write.mode("overwrite").json(path)


def read_tables(spark: SparkSession, path: str) -> list[list[int]]:
    return [r.cdf for r in spark.read.json(path).orderBy("ctx").collect()]


def write_report(df: DataFrame, path: str) -> None:
    """Rows as JSON objects, one a line."""
    df.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def changed_rows(new: DataFrame, accepted: DataFrame) -> DataFrame:
    """Rows that differ between a result and the accepted one, with the side that has them."""
    return new.exceptAll(accepted).withColumn("side", F.lit("new")).unionByName(accepted.exceptAll(new).withColumn("side", F.lit("accepted")))
