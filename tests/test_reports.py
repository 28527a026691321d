"""Stimulus files, vector sets and reports."""

import json

import numpy as np
import pytest

from axonwave.operators import codecs
from axonwave.sources import files, reports, stimulus


def test_stimulus_shapes(spark, tmp_path):
    slots = [1, 4, 9]
    full, own = np.arange(5 * 12).reshape(5, 12), np.arange(7 * 3).reshape(7, 3)
    np.save(tmp_path / "full.npy", full.astype(np.int16))
    np.savetxt(tmp_path / "own.csv", own, delimiter=",", fmt="%d")
    rows = stimulus.load_stimulus(spark, str(tmp_path), slots).collect()
    got = {name: {(r.frame, r.ch): r.code for r in rows if r.path.endswith(name)} for name in ("full.npy", "own.csv")}
    assert got["full.npy"] == {(t, c): full[t, s] for t in range(5) for c, s in enumerate(slots)}
    assert got["own.csv"] == {(t, c): own[t, c] for t in range(7) for c in range(3)}
    assert {(r.path[-8:], r.full) for r in rows} == {("full.npy", True), ("/own.csv", False)}
    np.save(tmp_path / "bad.npy", np.zeros((4, 5)))
    with pytest.raises(Exception, match="neither full frames"):
        stimulus.load_stimulus(spark, str(tmp_path / "bad.npy"), slots).count()


def test_frames_roundtrip(spark, tmp_path):
    x = files.synthetic(spark, 3, 4, 70, 2)
    stimulus.write_frames(x, str(tmp_path / "f"), 4, part=32)
    y = stimulus.read_frames(spark, str(tmp_path / "f"), 4)
    assert y.count() == 840 and y.exceptAll(x.select(*y.columns)).isEmpty()
    assert (tmp_path / "f" / "stream=2" / "part=2").is_dir()
    first = next((tmp_path / "f" / "stream=0" / "part=0").glob("part-*")).read_text().splitlines()
    assert [int(line.split(",")[0]) for line in first] == list(range(32))


def test_vector_set(spark, tmp_path):
    x = files.synthetic(spark, 1, 2, 256, 4)
    p = codecs.encode_lossless(x)
    slots = x.withColumnRenamed("ch", "slot")
    stimulus.write_vector_set(slots, p, {"mode": 0, "slots": [0, 1]}, str(tmp_path / "v"))
    words = spark.read.text(str(tmp_path / "v/input")).collect()
    want = {(r.frame, r.slot): r.code for r in slots.collect()}
    assert [int(r.value, 16) for r in words] == [want[k] for k in sorted(want)]
    assert stimulus.read_vector_config(spark, str(tmp_path / "v")) == {"mode": "0", "slots": "[0, 1]"}
    got, packets = files.read_vectors(spark, str(tmp_path / "v/expected")).orderBy("pos").collect(), [bytes(r.bytes) for r in p.orderBy("pkt").collect()]
    assert bytes(r.v for r in got) == b"".join(packets) and sum(r.last for r in got) == len(packets) == 2
    with pytest.raises(ValueError, match="too many"):
        stimulus.write_vector_set(slots, p, {}, str(tmp_path / "w"), most=8)


def test_summary(spark, tmp_path):
    m = spark.createDataFrame([("a", "speed", 3.0), ("a", "area", 9.5), ("b", "speed", 1.0), ("b", "extra", None), ("b", "free", 2.0)], "run string, name string, value double")
    b = spark.createDataFrame([("speed", 2.0, ">=", "MHz"), ("area", 9.0, "<=", None), ("extra", 1.0, "<=", "")], "name string, lim double, cmp string, unit string")
    s = reports.scored(m, b)
    assert {(r.run, r.name): r.status for r in s.collect()} == {("a", "speed"): "PASS", ("a", "area"): "FAIL", ("b", "speed"): "FAIL", ("b", "extra"): "N/A", ("b", "free"): "INFO"}
    reports.write_summary(s, str(tmp_path))
    text = next((tmp_path / "markdown" / "run=a").glob("part-*")).read_text().splitlines()
    assert text == ["# a", "1 of 2 failed", "| metric | value | limit | unit | status |", "|-|-|-|-|-|", "| area | 9.500 | 9.000 |  | FAIL |", "| speed | 3.000 | 2.000 | MHz | PASS |"]
    text = next((tmp_path / "markdown" / "run=b").glob("part-*")).read_text().splitlines()
    assert text[4:6] == ["| extra | - | 1.000 |  | N/A |", "| free | 2.000 | - |  | INFO |"]
    assert sorted(json.loads(x)["name"] for f in (tmp_path / "json").glob("part-*") for x in f.read_text().splitlines()) == ["area", "extra", "free", "speed", "speed"]
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).where("run = 'b'").count() == 3
