"""Frames as files, one row a frame and one column a slot: stimulus readers and writers, and sets of test vectors."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonwave.sources.files import write_vectors


def write_frames(x: DataFrame, path: str, n_ch: int, part: int = 1 << 16) -> None:
    """Samples as CSV lines `frame,code,code,...` in a folder for each stream; ranges of part frames are files of their own."""
    wide = x.groupBy("stream", "frame").agg(F.sort_array(F.collect_list(F.struct("ch", "code"))).alias("c")).where(F.size("c") == n_ch)
    lines = wide.select("stream", "frame", F.concat_ws(",", F.col("frame").cast("string"), F.transform("c", lambda v: v["code"].cast("string"))).alias("value"), F.floor(F.col("frame") / part).alias("part"))
    lines.repartition("stream", "part").sortWithinPartitions("stream", "frame").select("stream", "part", "value").write.mode("overwrite").partitionBy("stream", "part").text(path)


def read_frames(spark: SparkSession, path: str, n_ch: int) -> DataFrame:
    """What write_frames has written: stream, ch, frame, code."""
    rows = spark.read.schema("value string, stream long, part long").text(path).select("stream", F.split("value", ",").alias("v"))
    return rows.select("stream", F.element_at("v", 1).cast("long").alias("frame"), F.posexplode(F.slice("v", 2, n_ch)).alias("ch", "code")).select("stream", "ch", "frame", F.col("code").cast("long").alias("code"))


def load_stimulus(spark: SparkSession, path: str, slots: list[int]) -> DataFrame:
    """path, full, ch, frame, code of stimulus files: .npy matrices or comma-separated ones, one row a frame.

    Files with more columns than the highest slot hold full frames, of which the slots are taken; with one column for each slot (and not more than the highest), the
    selected channels. Any other shape is an error. A file is read by one task; files are the parallelism.
    """
    n, top = len(slots), max(slots)

    def many(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                data = bytes(r.content)
                a = np.load(io.BytesIO(data), allow_pickle=False) if r.path.endswith(".npy") else np.loadtxt(io.BytesIO(data), delimiter=",", ndmin=2)
                a = np.asarray(a, np.int64)
                full = a.ndim == 2 and a.shape[1] > top
                if not full and not (a.ndim == 2 and a.shape[1] == n):
                    raise ValueError(f"{r.path}: {a.shape} is neither full frames (more than {top} columns) nor {n} channels")
                x = a[:, slots] if full else a
                t = len(x)
                yield pd.DataFrame({"path": r.path, "full": full, "ch": np.tile(np.arange(n, dtype=np.int32), t), "frame": np.repeat(np.arange(t), n), "code": x.reshape(-1)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(many, "path string, full boolean, ch int, frame long, code long")


def write_vector_set(slots: DataFrame, packets: DataFrame, config: dict, path: str, most: int = 8192) -> None:
    """input (three hexadecimal digits a slot, in order), expected (packets, see write_vectors) and config (one JSON line) in folders of path. slots: frame, slot, code."""
    words = slots.select("frame", "slot", F.lower(F.lpad(F.hex("code"), 3, "0")).alias("value"))
    if words.count() >= most * 32:
        raise ValueError("a set of vectors is for a test bench: too many slots")
    words.orderBy("frame", "slot").select("value").coalesce(1).write.mode("overwrite").text(f"{path}/input")
    write_vectors(packets, f"{path}/expected", most)
    one = slots.sparkSession.createDataFrame([(k, str(v)) for k, v in sorted(config.items())], "k string, v string")
    one.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v"))))).alias("value")).write.mode("overwrite").text(f"{path}/config")


def read_vector_config(spark: SparkSession, path: str) -> dict[str, str]:
    return spark.read.text(f"{path}/config").select(F.from_json("value", "map<string,string>").alias("c")).where("c IS NOT NULL").first().c
