import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from marketlens.operators import pixels, recognition
from marketlens.streaming import ingest


def test_raster_steps():
    grey = np.full((20, 30), 240, np.uint8)
    grey[4:9, 3:8] = 20
    grey[5:8, 4:7] = 240
    grey[12:16, 10:12] = 30
    ink = pixels.binarize(grey)
    assert ink.sum() == 25 - 9 + 8
    assert pixels.row_bands(ink) == [(4, 9), (12, 16)] and pixels.segments(ink) == [(3, 8), (10, 12)]
    assert pixels.hole_count(ink[3:10, 2:9]) == 1 and pixels.hole_count(ink[11:17, 9:13]) == 0
    ruled = ink.copy()
    ruled[18, :] = True
    assert np.array_equal(pixels.without_rules(ruled), ink)
    a, b = pixels.fit(ink[3:10, 2:9]), pixels.fit(ink[11:17, 9:13])
    assert a.shape == (pixels.GLYPH_H, pixels.GLYPH_W) and pixels.ncc(a, a) > 0.999 > pixels.ncc(a, b)
    assert pixels.shifted_ncc(a, np.roll(a, 1, axis=1)) > 0.99
    x, y = pixels.features(ink[3:10, 2:9]), pixels.features(ink[11:17, 9:13])
    assert pixels.structural_score(x, x) == 1.0 and pixels.structural_score(x, y) < 0.8
    assert pixels.split_wide([(0, 10), (20, 50)], 10) == [(0, 10), (20, 30), (30, 40), (40, 50)]
    assert pixels.pitch_of([(0, 5), (10, 15), (21, 26)]) == 11.0
    assert pixels.ncc(np.zeros(4), np.ones(4)) == 0.0 and not pixels.fit(np.zeros((3, 3), bool)).any()


def test_image_columns(spark):
    grey = np.full((6, 8), 255, np.uint8)
    grey[1:3, 2:5] = 0
    df = spark.createDataFrame([(8, 6, 1, bytearray(grey.tobytes()))], "width int, height int, nChannels int, data binary").select(F.struct("width", "height", "nChannels", "data").alias("image"))
    r = df.select(pixels.row_band_column("image").alias("bands"), pixels.glyph_vector("image").alias("v")).first()
    assert [(x.a, x.b) for x in r.bands] == [(1, 3)] and len(r.v) == pixels.GLYPH_W * pixels.GLYPH_H


def test_greedy_steps(spark):
    bands = spark.createDataFrame([("g", 0, 5, 100), ("g", 10, 30, 100), ("g", 40, 60, 100), ("g", 80, 100, 100)], "grid string, top int, bottom int, height int")
    assert sorted(r.top for r in pixels.clipped_rows(bands).where("clipped").collect()) == [0]
    assert pixels.clipped_rows(bands.where("top < 20")).where("clipped").count() == 0  # fewer than three bands


def test_upper_median(spark):
    df = spark.createDataFrame([("a", x) for x in (1, 2, 3, 4)] + [("b", 5), ("b", None), ("c", None), ("d", 7), ("d", 7), ("d", 1)], "k string, x int")
    assert {tuple(r) for r in recognition.upper_medians(df, ["k"], "x").collect()} == {("a", 4, 2, 3), ("b", 1, 5, 5), ("d", 3, 7, 7)}
    big = spark.range(100_001).select(F.lit(1).alias("k"), F.pmod(F.col("id") * 7919, F.lit(1_000_003)).alias("x"))
    want = sorted(i * 7919 % 1_000_003 for i in range(100_001))[50_000]
    assert [tuple(r) for r in recognition.upper_medians(big, ["k"], "x").collect()] == [(1, 100_001, want, want)]
    assert recognition.upper_medians(big.where("false"), ["k"], "x").count() == 0


def test_stream_ingest(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    (src / "a.csv").write_text("Stat,List Price\nNEW,100000\n")
    ingest.ingest(spark, str(src), str(out), str(tmp_path / "cp")).awaitTermination()
    (src / "b.csv").write_text("Stat,List Price\nACTV,200000\n")
    ingest.ingest(spark, str(src), str(out), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.list_price for r in spark.read.parquet(str(out)).collect()) == [100000, 200000]
