"""Files in and out, signals through the kernels, and the streams."""

import hashlib
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import kernel_ops as K
from tidemark.operators import repair as R
from tidemark.sources import audio
from tidemark.streaming import clocks


def test_raw_samples_come_back_in_chunks(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(1000, 2)).astype("<f4")
    (tmp_path / "a.f32").write_bytes(x.tobytes())
    chunks = audio.raw_samples(spark, str(tmp_path), 8000, 2, chunk=300)
    assert sorted((r.start_frame, len(r.ch0)) for r in chunks.collect()) == [(0, 300), (300, 300), (600, 300), (900, 100)]
    whole = audio.whole_signals(chunks, "ch1").first()
    assert np.allclose(whole.samples, x[:, 1])
    faults = R.validate_chunks(chunks.select("series", "start_frame", F.col("ch0").alias("samples")), 300)
    assert faults.where("fault is not null").count() == 0


def test_torn_files_are_an_error(spark, tmp_path):
    (tmp_path / "a.f32").write_bytes(b"12345")
    with pytest.raises(Exception, match="no whole number of frames"):
        audio.raw_samples(spark, str(tmp_path), 8000).collect()


def test_pinned_content(spark, tmp_path):
    (tmp_path / "m.bin").write_bytes(b"model")
    (tmp_path / "n.bin").write_bytes(b"other")
    got = {r.series: r.ok for r in audio.checked_content(spark, str(tmp_path), {"m.bin": hashlib.sha256(b"model").hexdigest(), "n.bin": "00"}).collect()}
    assert got == {"m.bin": True, "n.bin": False}


@pytest.mark.parametrize(("text", "downbeats"), [("beat,seconds,model_score,downbeat\n0,0.24,0.98,true\n1,0.64,0.5,false\n", 1), ("0.24\n0.64\n", 0), ("time;strength\n0.24;0.98\n0.64;0.5\n", 0), ("seconds\tdownbeat\n0.24\ttrue\n0.64\tfalse\n", 1)])
def test_grids(spark, tmp_path, text, downbeats):
    path = tmp_path / "g.csv"
    path.write_text(text)
    rows = audio.grid(spark, str(path))
    assert [r.seconds for r in rows.orderBy("idx").collect()] == [0.24, 0.64]
    assert audio.first_downbeat(rows).count() == downbeats


def test_grids_of_several_shapes_are_read_together(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\ufeffseconds,score\n0.5,0.1\n\n0.25,\n")
    (tmp_path / "b.tsv").write_text("beat\ttime\tdownbeat\n7\t1.5\ttrue\n9\t2.5\t\n")
    (tmp_path / "c.csv").write_text("".join(f"{i / 4}\n" for i in range(500)))
    (tmp_path / "d.csv").write_text("")
    rows = {}
    for r in audio.grid(spark, str(tmp_path)).collect():
        rows.setdefault(r.series, []).append(tuple(r)[1:])
    assert rows["a.csv"] == [(0, 0.5, 0.1, None), (1, 0.25, None, None)] and rows["b.tsv"] == [(7, 1.5, None, True), (9, 2.5, None, None)]
    assert sorted(rows["c.csv"]) == [(i, i / 4, None, None) for i in range(500)] and set(rows) == {"a.csv", "b.tsv", "c.csv"}


def test_kept_signals_are_measured_once_and_read_anywhere(spark, tmp_path):
    x = np.random.default_rng(2).normal(size=1000)
    chunks = [("s", i, x[i : i + 300].tolist()) for i in range(0, 1000, 300)]
    path = f"{tmp_path}/stem"
    stem = audio.kept(spark.createDataFrame(chunks, "series string, start_frame long, samples array<double>"), path)
    again = audio.kept(spark.createDataFrame([], stem.schema), path)
    assert again.count() == 4
    asked = [("s", a, b) for a, b in ((0, 1000), (299, 301), (-50, 20), (990, 1400), (2000, 2010), (5, 5))] + [("t", 0, 3)]
    got = {(r.series, r["from"], r["to"]): r.samples for r in audio.prepared_frames(again, spark.createDataFrame(asked, "series string, from long, to long"), 300).collect()}
    wide = np.concatenate([np.zeros(50), x, np.zeros(2000)])
    assert got == {("s", a, b): wide[a + 50 : b + 50].tolist() for s, a, b in asked if s == "s" and b > a} | {("t", 0, 3): [0.0] * 3}
    assert audio.drop_kept(spark, path) and not audio.drop_kept(spark, path)


def test_wav():
    body, clipped = audio.wav24(np.array([[0.0, 1.5], [-1.0, 0.5]]), 44100)
    assert clipped == 1 and body[:4] == b"RIFF" and struct.unpack("<I", body[40:44])[0] == 12
    values = [int.from_bytes(body[i : i + 3], "little", signed=True) for i in range(44, 56, 3)]
    assert values == [0, 8388607, -8388607, 4194304]


def test_audits_are_written(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 2.0])], "series long, beats array<double>")
    for kind in ("csv", "tsv", "json"):
        audio.write_audit(rows, str(tmp_path / kind), kind)
    assert spark.read.csv(str(tmp_path / "tsv"), header=True, sep="\t").first().beats == "[1.0,2.0]"
    assert spark.read.json(str(tmp_path / "json")).first().beats == [1.0, 2.0]


def test_signals_are_analysed(spark):
    rate = 11025
    x = np.zeros(24 * rate)
    for t in np.arange(62) * 60 / 156:
        at, i = int(round(t * rate)), np.arange(121)
        x[at : at + 121] += (np.exp(-i / 19) * np.sin(0.6 * i))[: len(x) - at]
    signals = spark.createDataFrame(pd.DataFrame({"series": ["a", "b"], "rate": [rate, rate], "samples": [x.tolist(), x[: rate // 2].tolist()]}))
    good = K.valid_signals(signals)
    (found,) = K.analyze(good).collect()
    assert found.series == "a" and abs(found.bpm - 156) < 2 and len(found.beats) > 40
    assert audio.as_wav(good).first().clipped == 0


def test_resample_follows_anchors(spark):
    x = np.sin(np.arange(1000) / 20)
    signals = spark.createDataFrame([(1, x.tolist())], "series long, samples array<double>")
    anchors = spark.createDataFrame([(1, 0, 0, 0), (1, 1, 999, 1998)], "series long, i long, source_frame long, output_frame long")
    out = np.array(K.resample(signals, anchors).first().samples)
    assert len(out) == 1999 and np.allclose(out[::2], x)


def test_streams(spark, tmp_path):
    times = pd.to_datetime("2024-01-01") + pd.to_timedelta([0, 600, 3700, 40_000, 90_000], unit="s")
    pd.DataFrame({"series": ["a"] * 5, "ts": times.astype("datetime64[us]"), "x": [3.0, 4.0, 1.0, 1.0, 1.0], "seconds": [0.0, 600.0, 3700.0, 40_000.0, 90_000.0]}).to_parquet(tmp_path / "a.parquet")
    source = spark.readStream.schema("series string, ts timestamp, x double, seconds double").parquet(str(tmp_path))

    def run(df, mode, name):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    blocks = run(clocks.energy_blocks(source), "append", "blocks")
    first = min(blocks, key=lambda r: r.start)
    assert first.n == 2 and np.isclose(first.rms_db, 10 * np.log10(12.5))
    assert {r.n for r in run(clocks.sessions(source), "append", "runs")} >= {3}
    periods = run(clocks.track_period(source.select("series", "seconds")), "append", "periods")
    assert [round(r.period, 3) for r in sorted(periods, key=lambda r: r.seconds)][:2] == [600.0, 0.65 * 600 + 0.35 * 3100]
