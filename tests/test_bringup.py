import numpy as np

from axonwave import catalog
from axonwave.operators import wavelet
from axonwave.plans.samples import blocks
from axonwave.plans.signal_queries import lfsr_values
from axonwave.streaming.samples import lifted, streaming_coefficients

SF = "/root/testdata/sf0.01"


def test_flush_faults_are_found(spark):
    rows = catalog.queries()["flush_faults"](spark, SF).collect()
    assert rows and all((r.kind, r.channels, r.ch, r.bits) == ("flush", 1, r.pkt % 8, 1) and r.bit == r.pkt % 24 // 8 * 8 + r.pkt % 8 for r in rows)


def test_tables_by_band_beat_one(spark):
    rows = catalog.queries()["tdm_methods"](spark, SF).collect()
    assert rows and not any(r.wrong for r in rows) and sum(r.by_band for r in rows) <= sum(r.pooled for r in rows)


def test_summary_agrees_with_its_parts(spark):
    r = catalog.queries()["compress_summary"](spark, SF).first()
    p = catalog.queries()["lossy_packets"](spark, SF)
    assert r.samples == p.count() * 2048 and 0 < r.bps < 40


def test_lifting_in_blocks(spark):
    v = lfsr_values(1024)
    x = spark.createDataFrame([(0, 0, i, c) for i, c in enumerate(v)], "stream long, ch int, frame long, code long")
    want = {(r.blk, r.p): r.c for r in wavelet.forward(blocks(x)).collect()}
    got = lifted(np.array(v).reshape(-1, 64) - 512)
    assert want == {(b, p): int(got[b, p]) for b in range(16) for p in range(64)}


def test_streaming_lifting_equals_batch(spark, tmp_path):
    rows = [(int(s), int(c), f, int(v)) for s in range(2) for c in range(2) for f, v in enumerate(lfsr_values(300))]
    schema = "stream long, ch int, frame long, code long"
    for k in range(3):  # three batches, in order of frames
        spark.createDataFrame([r for r in rows if r[2] // 110 == k], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    x = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = streaming_coefficients(x).writeStream.format("memory").queryName("lifted").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.stream, r.ch, r.blk, r.p): r.c for r in spark.table("lifted").collect()}
    want = {(r.stream, r.ch, r.blk, r.p): r.c for r in wavelet.forward(blocks(spark.createDataFrame(rows, schema))).collect()}
    assert got == want and len(got) == 4 * 256
