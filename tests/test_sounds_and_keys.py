"""Features of known sounds, and key columns from sketches of files."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessella.operators import encoder
from tessella.sources import quality

SMALL = "/root/testdata/sf0.001"


def test_features_of_known_sounds(spark):
    t = np.arange(44_100) / 44_100
    tone, noise = 0.5 * np.sin(2 * np.pi * 440 * t), np.random.default_rng(1).normal(0, 0.2, 44_100)
    beats = tone * (np.sin(2 * np.pi * 4 * t) > 0)
    rows = [("tone", tone.tolist()), ("noise", noise.tolist()), ("beats", beats.tolist()), ("silence", [0.0] * 5000), ("short", [0.1] * 10), ("none", None), ("odd", [None, float("nan")] + tone.tolist()[2:])]
    got = {r.name: r for r in encoder.encoded(spark.createDataFrame(rows, "name string, samples array<double>")).collect()}
    tone, noise = got["tone"], got["noise"]
    assert (tone.rms, tone.centroid_hz, tone.duration_sec, tone.activity) == (0.354, 440.0, 1.0, 1.0) and tone.flatness < 0.001 and tone.voicing > 0.9 and tone.speech_band_ratio > 0.99
    assert abs(noise.centroid_hz - 11_025) < 150 and noise.flatness > 0.8 and abs(noise.rolloff_hz / 22_050 - 0.85) < 0.01 and noise.voicing < 0.1
    assert got["beats"].activity < 0.7 and got["beats"].dynamic_range > tone.dynamic_range
    assert (got["silence"].activity, got["silence"].rms, got["short"].activity, got["none"].rms) == (0.0, 0.0, 0.0, None) and abs(got["odd"].centroid_hz - 440) < 5


def test_frames_equal_a_plain_transform():
    x = np.random.default_rng(2).normal(0, 0.3, 700)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(64) / 63)
    found, hz = [], np.arange(32) * 8000 / 64
    for at in range(0, 700 - 63, 32):
        mag = np.array([abs(sum(window[i] * x[at + i] * np.exp(-2j * np.pi * k * i / 64) for i in range(64))) for k in range(32)])
        found.append((mag * hz).sum() / mag.sum())
    measured = encoder.measure(x, 8000, 64, 32)
    assert abs(measured[3] - np.mean(found)) < 1e-6
    encoder.BLOCK, before = 3, encoder.BLOCK
    try:
        assert np.allclose(encoder.measure(x, 8000, 64, 32), measured)
    finally:
        encoder.BLOCK = before


def test_sketches_of_files_merge(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(20_000).select("id", (F.col("id") % 7000).alias("device_id"), F.when(F.col("id") > 5, F.col("id")).alias("holes"), (F.col("id") * 0.5).alias("half"))
    rows.repartition(3).write.parquet(path)
    df = spark.read.parquet(path)
    parts = quality.column_sketches(df)
    kept = str(tmp_path / "sketches")
    parts.write.parquet(kept)
    assert parts.count() == 12
    merged = {r.column: r for r in quality.merged_sketches(spark.read.parquet(kept)).collect()}
    assert all(abs(merged[c].distinct / n - 1) < 0.03 for c, n in (("id", 20_000), ("device_id", 7000), ("holes", 19_994), ("half", 20_000))) and merged["id"].files == 3
    found = {r.column: r for r in quality.key_columns(df, spark.read.parquet(kept)).collect()}
    assert {c for c, r in found.items() if r.is_key} == {"id", "half"} and {c for c, r in found.items() if r.is_user} == {"device_id"} and found["holes"].nulls == 6
    spark.createDataFrame([(1, "a")] * 50, "id int, x string").write.parquet(str(tmp_path / "u"))
    assert not any(r.is_key for r in quality.key_columns(spark.read.parquet(str(tmp_path / "u"))).collect())
