import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from axonwave.operators.codecs import high_passed
from axonwave.sources import files
from axonwave.streaming.samples import packet_counts, streaming_high_pass


def _wav(path, codes, rate=19531, channels=1):
    x = np.round(np.asarray(codes) * 65535 / 1023).astype(np.int64) - 32768
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(x.astype("<i2").tobytes())


def test_wav_files_stack(spark, tmp_path):
    a, b = np.arange(1000) % 1024, (np.arange(1200) * 7) % 1024
    _wav(tmp_path / "a.wav", a)
    _wav(tmp_path / "b.wav", b)
    out = files.stacked(files.as_codes(files.read_wav(spark, str(tmp_path))), 2)
    assert out.count() == 2000
    got = [r.code for r in out.where("ch = 1").orderBy("frame").collect()]
    assert (np.diff(got) == np.diff(b[:1000])).all()


def test_stereo_is_refused(spark, tmp_path):
    _wav(tmp_path / "s.wav", [1, 2, 3, 4], channels=2)
    with pytest.raises(Exception, match="mono"):
        files.read_wav(spark, str(tmp_path)).count()


def test_capture_roundtrip(spark, tmp_path):
    (tmp_path / "c.txt").write_text("40 1f L # first\nA\n41L ovf\nff\n")
    t = files.read_capture(spark, str(tmp_path / "c.txt"))
    rows = [(r.kind, r.v, r.last) for r in t.orderBy("pos").collect()]
    assert rows == [("B", 64, False), ("B", 31, True), ("A", None, False), ("B", 65, True), ("O", None, False), ("B", 255, False)]
    files.write_capture(t, str(tmp_path / "out"))
    back = files.read_capture(spark, str(tmp_path / "out"))
    assert [(r.kind, r.v, r.last) for r in back.orderBy("pos").collect()] == rows


def test_vectors_roundtrip(spark, tmp_path):
    p = spark.createDataFrame([(0, bytearray(b"\x40\x01\x02")), (1, bytearray(b"\x41\xff"))], "pkt long, bytes binary")
    files.write_vectors(p, str(tmp_path / "v"))
    got = [(r.v, r.last) for r in files.read_vectors(spark, str(tmp_path / "v")).orderBy("pos").collect()]
    assert got == [(64, False), (1, False), (2, True), (65, False), (255, True)]


def test_reports_and_netlists(spark, tmp_path):
    (tmp_path / "j.xml").write_text('<s><testcase name="a" time="1.5"/><testcase name="b" time="2"><failure/></testcase></s>')
    assert {(r.name, r.seconds, r.failed) for r in files.read_junit(spark, str(tmp_path / "j.xml")).collect()} == {("a", 1.5, False), ("b", 2.0, True)}
    (tmp_path / "n.v").write_text("module m(a);\n wire w;\n buf_1 u1 (.A(a), .X(w));\n inv_2 u2 (.A(w), .Y());\nendmodule")
    assert {(r.inst, r.pin, r.net) for r in files.read_netlist(spark, str(tmp_path / "n.v")).collect()} == {("u1", "A", "a"), ("u1", "X", "w"), ("u2", "A", "w")}
    (tmp_path / "d.vcd").write_text("$var wire 1 ! clk $end\n#0\n0!\n#5\n1!\nx!\n#9\n0!\n")
    assert [(r.t, r.net, r.v) for r in files.read_vcd(spark, str(tmp_path / "d.vcd")).orderBy("i").collect()] == [(0, "clk", 0), (5, "clk", 1), (5, "clk", None), (9, "clk", 0)]
    files.write_tables([[0, 3, 4096], [0, 9, 4096]], spark, str(tmp_path / "t"))
    assert files.read_tables(spark, str(tmp_path / "t")) == [[0, 3, 4096], [0, 9, 4096]]
    a, b = spark.createDataFrame([(1,), (2,)], "x int"), spark.createDataFrame([(2,), (3,)], "x int")
    assert {(r.x, r.side) for r in files.changed_rows(a, b).collect()} == {(1, "new"), (3, "accepted")}


def test_synthetic_is_seeded(spark):
    x = files.synthetic(spark, 2, 3, 200, 5)
    assert x.count() == 1200 and x.exceptAll(files.synthetic(spark, 2, 3, 200, 5)).isEmpty()
    assert x.where("code < 0 OR code > 1023").isEmpty()


def test_stream_equals_batch(spark, tmp_path):
    x = files.synthetic(spark, 1, 2, 600, 3)
    for k in range(3):
        x.where((F.col("frame") >= 200 * k) & (F.col("frame") < 200 * (k + 1))).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(x.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    for name, df, mode in (("hp_out", streaming_high_pass(stream), "append"), ("pk_out", packet_counts(stream), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    batch = high_passed(x).select("stream", "ch", "frame", "hp")
    assert spark.table("hp_out").exceptAll(batch).isEmpty() and spark.table("hp_out").count() == 1200
    assert spark.table("pk_out").agg(F.sum("n")).first()[0] == 1200
