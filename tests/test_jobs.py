"""The jobs on growing copies of small tables, with awkward rows, repeated and interrupted."""

import datetime as dt
import math
import os
import random
import subprocess
import sys
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from axonwave.functions import coding
from axonwave.operators.numbering import numbered
from jobs import common, packet_intake, rate_survey
from jobs.packet_intake import Intake

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
R = random.Random(3)


def _event(k, user, value):
    return (k, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=40 * k), user, "view", value, None)


def _events(first, n):
    """A third of all rows are of user 1."""
    return [_event(k, 1 if k % 3 == 0 else R.randint(2, 6), R.choice([R.uniform(-5, 1100), 512.5, 513.5])) for k in range(first, first + n)]


def _put(spark, rows, at):
    """One more file of the table."""
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(at)


def _want(rows, cfg):
    by = {}
    for k, ts, user, _, value, _ in rows:
        by.setdefault(user, {})[k] = (max(0, min(cfg.top_code, round(value))), ts)
    out = Counter()
    for user, of in by.items():
        ids = sorted(of)
        for p in range(len(ids) // cfg.frames):
            own = ids[p * cfg.frames : (p + 1) * cfg.frames]
            import numpy as np

            packet = coding.rice_packet(np.array([of[k][0] for k in own])[:, None], p)
            out[user, p, p % 64, cfg.frames, own[0], own[-1], packet, of[own[-1]][1].strftime("%Y-%m-%d")] += 1
    return out


def _got(df):
    return Counter((r.stream, r.pkt, r.seq, r.n_samples, r.first_event_id, r.last_event_id, bytes(r.packet), r.day) for r in df.collect())


def test_intake_of_growing_input(spark, tmp_path):
    src, out, checkpoint = (str(tmp_path / n) for n in ("events.parquet", "out", "checkpoint"))
    cfg, a, b = Intake(frames=8), _events(0, 500), _events(500, 400)
    _put(spark, [*a, a[7], (None, None, 1, "x", 3.0, None), (900_001, None, None, "x", 3.0, None), (900_002, None, 1, "x", None, None), (900_003, None, 1, "x", math.nan, None)], src)
    assert _got(packet_intake.run(spark, src, out, checkpoint, cfg)) == _want(a, cfg)
    before = {f: os.path.getmtime(f) for f in _files(out)}
    assert _got(packet_intake.run(spark, src, out, checkpoint, cfg)) == _want(a, cfg)  # nothing new: nothing done
    assert {f: os.path.getmtime(f) for f in _files(out)} == before
    _put(spark, [*b, a[3], b[9]], src)  # one row comes again after its stream has gone on
    assert _got(packet_intake.run(spark, src, out, checkpoint, cfg)) == _want(a + b, cfg)
    bad = Counter(r.reason for r in spark.read.parquet(f"{out}/rejected").collect())
    assert bad == {"incomplete": 4, "late": 1}
    marks = {r.stream: r.next_frame for r in spark.read.parquet(f"{out}/marks").where("batch = 1").collect()}
    assert marks == dict(Counter(e[2] for e in a + b))
    once = packet_intake.run(spark, src, str(tmp_path / "o2"), str(tmp_path / "c2"), cfg)  # all files in one batch
    assert _got(once) == _want(a + b, cfg)


def _files(at):
    return [os.path.join(d, f) for d, _, fs in os.walk(at) for f in fs]


def test_intake_repeats_a_batch_that_failed(spark, tmp_path, monkeypatch):
    src, out, checkpoint = (str(tmp_path / n) for n in ("events", "out", "checkpoint"))
    cfg, a, b = Intake(frames=8), _events(0, 200), _events(200, 200)
    _put(spark, a, src)
    packet_intake.run(spark, src, out, checkpoint, cfg)
    _put(spark, b, src)
    done = packet_intake.take_batch

    def fails(*args):
        done(*args)
        raise RuntimeError("after the writes, before the checkpoint")

    monkeypatch.setattr(packet_intake, "take_batch", fails)
    with pytest.raises(Exception, match="after the writes"):
        packet_intake.run(spark, src, out, checkpoint, cfg)
    monkeypatch.undo()
    assert _got(packet_intake.run(spark, src, out, checkpoint, cfg)) == _want(a + b, cfg)


def test_intake_of_an_empty_table(spark, tmp_path):
    src = str(tmp_path / "events")
    spark.createDataFrame([], EVENTS).write.parquet(src)
    assert packet_intake.run(spark, src, str(tmp_path / "out"), str(tmp_path / "c")).count() == 0
    _put(spark, _events(0, 400), src)
    assert packet_intake.run(spark, src, str(tmp_path / "out"), str(tmp_path / "c")).count() > 0


def _program(name, *args):
    """A job's file as a program, in a session of its own, with the config beside it; what it has logged."""
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    said = subprocess.run([sys.executable, f"{ROOT}/jobs/{name}.py", *args, "--config", f"{ROOT}/jobs/{name}.json"], cwd="/", env=env, capture_output=True, text=True, timeout=300)
    assert said.returncode == 0, said.stderr[-2000:]
    return said.stderr


def test_command_lines(spark, tmp_path):
    src, cfg, a = str(tmp_path / "events"), Intake(), _events(0, 300)
    _put(spark, a, src)
    said = _program("packet_intake", "--source", src, "--out", str(tmp_path / "out"), "--checkpoint", str(tmp_path / "c"))
    assert "read 300 new rows" in said
    assert _got(packet_intake.packets(spark, str(tmp_path / "out"))) == _want(a, cfg)
    docs = [(k, "en", "s", "some words " * k) for k in range(9)]
    spark.createDataFrame(docs, "doc_id long, lang string, source string, text string").write.parquet(str(tmp_path / "docs"))
    said = _program("rate_survey", "--source", str(tmp_path / "docs"), "--out", str(tmp_path / "rates"))
    assert "read 9 rows" in said and "wrote 9 documents, 1 sources" in said
    assert Counter(tuple(r) for r in rate_survey.documents(spark, str(tmp_path / "rates")).collect()) == _rates(docs, rate_survey.Survey())


def test_configs(spark, tmp_path):
    assert common.config_of(spark, f"{ROOT}/jobs/rate_survey.json", rate_survey.Survey) == rate_survey.Survey()
    assert common.config_of(spark, f"{ROOT}/jobs/packet_intake.json", Intake) == Intake()
    (tmp_path / "x.json").write_text('{"frame": 3}')
    with pytest.raises(TypeError):
        common.config_of(spark, str(tmp_path / "x.json"), Intake)


def _rates(docs, cfg):
    """The survey's columns byte by byte."""
    half = lambda d: int((d or 0) % 65536 * 40503 % 65536 >= 32768)
    counts = {}
    for doc, _, source, text in docs:
        counts.setdefault((source, half(doc)), Counter()).update((text or "").encode())
    out = Counter()
    for doc, lang, source, text in docs:
        x = (text or "").encode()
        d = [(b - a + 128) % 256 - 128 for a, b in zip(x, x[1:])]
        m = [2 * e if e >= 0 else -2 * e - 1 for e in d]
        rice = [sum((v >> k) + 1 + k if v >> k < cfg.prefix_limit else cfg.prefix_limit + 8 for v in m) for k in range(9)]
        k = rice.index(min(rice))
        rice_bits, raw = rice[k] + 8 * bool(x), 8 * len(x)
        other = counts.get((source, 1 - half(doc)))
        total = sum(other.values()) if other else 0
        table = sum(round(-1000 * math.log2((other[b] + 0.5) / (total + 128))) for b in x) if total else 8000 * len(x)
        best = min((raw, 0, "raw"), (rice_bits, 1, "rice"), (-(-table // 1000), 2, "table"))
        out[doc, lang, source, len(x), k, rice_bits, table, best[2], best[0], len(x) >= cfg.least_bytes and best[0] > cfg.limit_bits * len(x)] += 1
    return out


def test_rate_survey(spark, tmp_path):
    words = ["alpha", "beta", "Ünï", "日本", "1234", "\n"]
    docs = [(k, [None, "", "en", "1"][k % 4], [None, "a", "b"][k % 3] if k % 2 else "hot", " ".join(R.choice(words) for _ in range(R.randint(0, 60)))) for k in range(120)]
    docs += [(500, "en", "hot", None), (501, "en", "hot", ""), (None, "en", "hot", "no id"), docs[5], docs[5], (502, "de", "alone", "x" * 30_000), (-7, "en", "hot", "negative id")]
    src, out, cfg = str(tmp_path / "docs"), str(tmp_path / "out"), rate_survey.Survey(limit_bits=4.0)
    spark.createDataFrame([(*d, 1, "clash") for d in docs], "doc_id long, lang string, source string, text string, fold int, part string").repartition(3).write.parquet(src)
    want = _rates(docs, cfg)
    for _ in range(2):  # the second run leaves the same
        assert Counter(tuple(r) for r in rate_survey.run(spark, src, out, cfg).collect()) == want
    sources = spark.read.parquet(f"{out}/sources").collect()
    assert sum(r.documents for r in sources) == len(docs) and len(sources) == len({d[1:3] for d in docs})
    for r in sources:
        own = {k: n for k, n in want.items() if k[1:3] == (r.lang, r.source)}
        assert r.over_budget == sum(n for k, n in own.items() if k[9]) and r.best_bits == sum(n * k[8] for k, n in own.items())
    spark.createDataFrame([], "doc_id long, lang string, source string, text string").write.parquet(str(tmp_path / "none"))
    assert rate_survey.run(spark, str(tmp_path / "none"), str(tmp_path / "out2")).count() == 0


def test_numbered(spark):
    x = spark.range(3000).select((F.col("id") * 7 % 3001).alias("k"), F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 5).alias("key"))
    want = x.withColumn("n", (F.row_number().over(Window.partitionBy("key").orderBy("k")) - 1).cast("long"))
    for span in (16, 1000, 1 << 16):
        got = numbered(x, ["key"], "k", span=span)
        assert got.columns == want.columns and got.exceptAll(want).isEmpty() and got.count() == 3000
