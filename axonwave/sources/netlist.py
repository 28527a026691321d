"""Structural netlists with their cell library: pins, ports and aliases as relations, and the net graph over alias classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from axonwave.operators.graphs import components
from axonwave.sources.files import read_netlist


def _plain(net: Column) -> Column:
    """A net's name without the escape and blanks of the source text."""
    return F.regexp_replace(net, r"[\\\s]", "")


def read_liberty(spark: SparkSession, path: str) -> DataFrame:
    """cell, area, pin, output of every pin of the library's cells. Files are read whole; groups are split where the next one begins."""
    text = spark.read.text(path, wholetext=True).select(F.explode(F.split(F.regexp_replace("value", r"(?s)/\*.*?\*/", ""), r"(?<![\w])(?=cell\s*\()")).alias("c"))
    cell = text.select(F.regexp_extract("c", r'^cell\s*\(\s*"?(\w+)', 1).alias("cell"), "c").where("cell != ''")
    area = F.coalesce(F.regexp_extract("c", r"\barea\s*:\s*([\d.]+)", 1).try_cast("double"), F.lit(0.0))
    pins = cell.select("cell", area.alias("area"), F.explode(F.split("c", r"(?<![\w])(?=pin\s*\()")).alias("p"))
    pins = pins.select("cell", "area", F.regexp_extract("p", r'^pin\s*\(\s*"?(\w+)', 1).alias("pin"), F.regexp_extract("p", r'\bdirection\s*:\s*"?(\w+)', 1).alias("way"))
    return pins.where("pin != ''").select("cell", "area", "pin", (F.col("way") == "output").alias("output"))


def _statements(spark: SparkSession, path: str) -> DataFrame:
    text = F.regexp_replace("value", r"//[^\n]*|(?s)/\*.*?\*/", "")
    return spark.read.text(path, wholetext=True).select(F.explode(F.split(text, ";")).alias("s"))


def read_ports(spark: SparkSession, path: str) -> DataFrame:
    """port, output: declared ports, a vector as one port for each bit."""
    shape = r"^\s*(input|output)\s+(?:wire\s+)?(?:\[\s*(\d+)\s*:\s*(\d+)\s*\]\s*)?(\w+)\s*$"
    p = _statements(spark, path).select(*[F.regexp_extract("s", shape, k).alias(n) for k, n in enumerate(("way", "hi", "lo", "name"), 1)]).where("way != ''")
    bits = F.sequence(F.least(F.col("lo").try_cast("int"), F.col("hi").try_cast("int")), F.greatest(F.col("lo").try_cast("int"), F.col("hi").try_cast("int")))
    names = F.when(F.col("hi") == "", F.array("name")).otherwise(F.transform(bits, lambda b: F.concat("name", F.lit("["), b.cast("string"), F.lit("]"))))
    return p.select(F.explode(names).alias("port"), (F.col("way") == "output").alias("output"))


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """a, b of every `assign a = b` between nets; constants are none."""
    shape = r"^\s*assign\s+(\S+(?:\s*\[\d+\])?)\s*=\s*(\S+(?:\s*\[\d+\])?)\s*$"
    a = _statements(spark, path).select(_plain(F.regexp_extract("s", shape, 1)).alias("a"), _plain(F.regexp_extract("s", shape, 2)).alias("b"))
    return a.where("a != '' AND NOT b LIKE '%''%'")


def net_graph(pins: DataFrame, library: DataFrame, ports: DataFrame, aliases: DataFrame) -> DataFrame:
    """net, inst, cell, pin, output, area: every end of every net, under the least name of the nets that assigns make one. Ports are ends without a cell.

    An end with output drives the net: an output pin of a cell, or an input port. Pins that the library does not know are inputs.
    """
    known = library.select("cell", "pin", "output", "area")
    ends = pins.select(_plain(F.col("net")).alias("net"), "inst", "cell", "pin").where("NOT net LIKE '%''%'").join(known, ["cell", "pin"], "left")
    ends = ends.select("net", "inst", "cell", "pin", F.coalesce("output", F.lit(False)).alias("output"), F.coalesce("area", F.lit(0.0)).alias("area"))
    own = ports.select(F.col("port").alias("net"), F.lit("").alias("inst"), F.lit(None).cast("string").alias("cell"), F.col("port").alias("pin"), (~F.col("output")).alias("output"), F.lit(0.0).alias("area"))
    rep = components(aliases).select(F.col("node").alias("net"), "rep")
    return ends.unionByName(own).join(rep, "net", "left").withColumn("net", F.coalesce("rep", "net")).drop("rep")


def connections(graph: DataFrame) -> DataFrame:
    """net, inst, cell, pin, to_inst, to_cell, to_pin: driver and sink of each connection. A net's driver meets its sinks, not sinks each other."""
    drive = graph.where("output").select("net", "inst", "cell", "pin")
    sink = graph.where("NOT output").select("net", F.col("inst").alias("to_inst"), F.col("cell").alias("to_cell"), F.col("pin").alias("to_pin"))
    return drive.join(sink, "net")


def pin_activity(changes: DataFrame, graph: DataFrame, aliases: DataFrame) -> DataFrame:
    """inst, pin, toggles of each driver, from a dump's changes(path, t, i, net, v): its nets go by any of their alias names."""
    w = Window.partitionBy("path", "net").orderBy("i")
    step = changes.withColumn("_was", F.lag("v").over(w)).where("v != _was").groupBy("net").agg(F.count("*").alias("toggles"))
    rep = components(aliases).select(F.col("node").alias("net"), "rep")
    per = step.join(rep, "net", "left").groupBy(F.coalesce("rep", "net").alias("net")).agg(F.max("toggles").alias("toggles"))  # one net under several names toggles once
    return graph.where("output").join(per, "net", "left").select("inst", "pin", F.coalesce("toggles", F.lit(0)).alias("toggles"))


def read_design(spark: SparkSession, path: str, library: DataFrame) -> DataFrame:
    """The net graph of a netlist file (or a folder of parts of one)."""
    return net_graph(read_netlist(spark, path), library, read_ports(spark, path), read_aliases(spark, path))
