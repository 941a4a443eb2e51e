import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.operators import shading

SCHEMA = "grid int, y int, x int, level int"


def plain_percentile(values, p):
    return sorted(values)[max(1, math.floor(len(values) * p + 0.5)) - 1]


def plain_flatten(image, scale=1.0):
    """Scanline by scanline over one image (a list of rows of levels): the bands and the new image."""
    level = [plain_percentile(r, 0.5) for r in image]
    bg = sorted(level)[len(level) // 2]
    dark = [v <= bg - 12 for v in level] + [False]
    out, bands, top = [list(r) for r in image], [], None
    rest = [v for r, d in zip(image, dark) if not d for v in r]
    fg = plain_percentile(rest, 0.02) if rest else None
    for y, d in enumerate(dark):
        if d and top is None:
            top = y
        if d or top is None:
            continue
        inside, a, top = [v for r in image[top:y] for v in r], top, None
        if y - a < 3 * scale or fg is None or bg - fg < 40:
            continue
        b, lo, hi = (plain_percentile(inside, p) for p in (0.5, 0.02, 0.98))
        inverted = hi - b > b - lo
        f = hi if inverted else lo
        if abs(b - f) < 20:
            continue
        factor = (bg - fg) / abs(b - f)
        bands.append((a, y - a, b, f, bg, fg, round(factor, 9), inverted))
        for i in range(a, y):
            out[i] = [max(0, min(255, math.floor(fg + (f - v if inverted else v - f) * factor + 0.5))) for v in image[i]]
    return bands, out


def drawn(seed, height=40, width=30):
    """Paper with text, and bands of other fills: light text on dark, dark text on grey, a rule, a flat fill."""
    r = np.random.default_rng(seed)
    fill = np.full(height, 240)
    ink = np.full(height, 20)
    for top, h, f, i in ((4, 5, 60, 230), (14, 4, 180, 90), (22, 2, 100, 10), (28, 5, 120, 118)):
        fill[top : top + h], ink[top : top + h] = f, i
    text = r.random((height, width)) < 0.2
    return np.clip(np.where(text, ink[:, None], fill[:, None]) + r.integers(-3, 4, (height, width)), 0, 255).tolist()


def pixels(spark, images):
    return spark.createDataFrame([(g, y, x, v) for g, image in enumerate(images) for y, row in enumerate(image) for x, v in enumerate(row)], SCHEMA)


@pytest.mark.parametrize("scale", [1.0, 1.5])
def test_bands_and_levels_match_a_plain_pass(spark, scale):
    images = [drawn(1), drawn(2), np.random.default_rng(3).integers(0, 256, (30, 7)).tolist(), [[200] * 5] * 6, [[255], [0], [0], [0], [250]]]
    rows = pixels(spark, images).withColumn("n", F.lit("kept"))
    bands = shading.shaded_bands(rows, scale)
    want = [plain_flatten(i, scale) for i in images]
    got = sorted((r.grid, r.y, r.height, r.band_bg, r.band_fg, r.page_bg, r.page_fg, round(r.factor, 9), r.inverted) for r in bands.collect())
    assert got == sorted((g, *b) for g, (found, _) in enumerate(want) for b in found) and got
    if scale == 1.0:
        assert {b[:2] for b in want[0][0]} == {(4, 5), (14, 4)} and [b[7] for b in want[0][0]] == [True, False]
    flat = shading.flattened(rows, bands).collect()
    assert {r.n for r in flat} == {"kept"}
    assert sorted((r.grid, r.y, r.x, r.flat) for r in flat) == sorted((g, y, x, v) for g, (_, out) in enumerate(want) for y, row in enumerate(out) for x, v in enumerate(row))


def test_nulls_and_empty_images(spark):
    rows = spark.createDataFrame([(None, 0, 0, 5), (0, None, 0, 5), (0, 0, 0, None), (0, 0, 1, 7)], SCHEMA)
    bands = shading.shaded_bands(rows)
    assert bands.count() == 0
    assert sorted(((r.level, r.flat) for r in shading.flattened(rows, bands).collect()), key=str) == [(5, 5), (5, 5), (7, 7), (None, None)]
    assert shading.flattened(rows.limit(0), bands).count() == 0


def test_percentile_is_the_nearest_rank(spark):
    values = [3, 3, 9, 200, 41]
    rows = spark.createDataFrame([(0, 0, x, v) for x, v in enumerate(values)], SCHEMA)
    shares = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.9, "e": 1.0}
    got = shading.percentiles(shading.histogram(rows, ["grid"]), ["grid"], shares).first()
    assert [got[k] for k in shares] == [plain_percentile(values, p) for p in shares.values()] and got.n_all == 5


def test_upscaled_and_cropped(spark):
    up = shading.upscaled(spark.createDataFrame([(0, 0, 0, 10), (0, 1, 2, 20)], SCHEMA), 2)
    assert sorted((r.y, r.x, r.level) for r in up.collect()) == [(0, 0, 10), (0, 1, 10), (1, 0, 10), (1, 1, 10), (2, 4, 20), (2, 5, 20), (3, 4, 20), (3, 5, 20)]
    boxes = spark.createDataFrame([(0, "a", 1, 3, 1, 5)], "grid int, box string, top int, bottom int, left int, right int")
    assert sorted((r.box, r.y, r.x, r.level) for r in shading.cropped(up, boxes).collect()) == [("a", 0, 0, 10), ("a", 1, 3, 20)]
