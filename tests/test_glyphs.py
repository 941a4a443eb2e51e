"""Segments, components and holes of glyphs against plain loops."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from marketlens.operators import glyphs, pixels
from marketlens.plans import layers
from tests.conftest import DATA


def raw(p, least):
    out, start = [], None
    for x, v in enumerate([*p, 0]):
        if v > 0 and start is None:
            start = x
        if v <= 0 and start is not None:
            if x - start >= least:
                out.append((start, x - start))
            start = None
    return out


def merged(segs, target):
    segs = list(segs)
    while len(segs) > max(target, 1):
        k = min(range(len(segs) - 1), key=lambda i: (segs[i + 1][0] - sum(segs[i]), i))
        segs[k : k + 2] = [(segs[k][0], sum(segs[k + 1]) - segs[k][0])]
    return segs


def split(segs, p, least, target):
    segs = list(segs)
    while len(segs) < target:
        k = max(range(len(segs)), key=lambda i: (segs[i][1], -i))
        x, w = segs[k]
        if w < least * 2:
            break
        others = sorted(s[1] for i, s in enumerate(segs) if i != k)
        usual = others[len(others) // 2] if others else 0
        n = max(2, min(math.floor(w / usual + 0.5) if usual else 2, max(2, target - len(segs) + 1)))
        cut = min(range(x + int(w * 0.25), x + int(w * 0.75) + 1), key=lambda q: (p[q] + 1.5 * min(abs(q - x - w * i / n) for i in range(1, n)), q))
        if cut - x < least or x + w - cut < least:
            break
        segs[k : k + 1] = [(x, cut - x), (cut, x + w - cut)]
    return segs


def plain(p, least, target):
    r = raw(p, least)
    if len(r) == target:
        return r, "projection"
    s = merged(r, target) if target < len(r) <= target + 4 else r
    if max(4, target - 4) <= len(s) < target:
        s = split(s, p, least, target)
    return s, "projection-adjusted" if len(s) == target else "projection-failed"


def test_digit_segments(spark):
    rng, rows = random.Random(7), [(-1, [], 3)]
    for i in range(500):
        n, p = rng.randint(1, 9), []
        for _ in range(n):
            p += [rng.randint(1, 7) if rng.random() > 0.06 else 0 for _ in range(rng.randint(2, 7))] + [0] * rng.choice([0, 1, 1, 2])
        rows.append((i, p, max(1, n + rng.choice([0, 0, 1, -1]))))
    df = spark.createDataFrame(rows, "i int, p array<int>, t int").select("i", glyphs.digit_segments(F.col("p"), 2, F.col("t")).alias("d"))
    got = {r.i: ([tuple(s) for s in r.d.segments], r.d.method) for r in df.collect()}
    want = {i: plain(p, 2, t) for i, p, t in rows}
    assert got == want and len(Counter(m for _, m in want.values())) == 3


def test_digit_segments_query(spark):
    got = {r.p_partkey: (r.segments, r.method) for r in layers.digit_segments(spark, f"{DATA}/sf0.001").collect()}
    want = {r.p_partkey: plain(r.projection, 1, r.digits) for r in layers.projections(spark, f"{DATA}/sf0.001").collect()}
    assert got == {k: (" ".join(f"{x}+{w}" for x, w in s), m) for k, (s, m) in want.items()} and len({m for _, m in got.values()}) > 1


def test_parts_stand_in_for_a_failed_projection(spark):
    boxes = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(w).alias("w"), F.lit(a).alias("area")) for x, w, a in ((0, 5, 20), (3, 4, 20), (12, 5, 20), (20, 5, 20), (40, 3, 2))])
    get = lambda c: spark.range(1).select(c.alias("c")).first().c
    assert [tuple(s) for s in get(glyphs.grouped_parts(boxes, 10, F.lit(3)))] == [(0, 7), (12, 5), (20, 5)]
    assert [tuple(s) for s in get(glyphs.grouped_parts(boxes, 10, F.lit(2)))] == [(0, 7), (12, 13)] and get(glyphs.grouped_parts(boxes, 10, F.lit(4))) is None
    solid = F.array(*[F.lit(1)] * 25)
    r = get(glyphs.digit_segments(solid, 2, F.lit(3), glyphs.grouped_parts(boxes, 10, F.lit(3))))
    assert r.method == "cc-fallback" and [tuple(s) for s in r.segments] == [(0, 7), (12, 5), (20, 5)]


def test_components_and_holes(spark):
    rng = random.Random(3)
    rasters = [(i, [rng.random() for _ in range(8 * rng.randint(3, 9))]) for i in range(200)] + [(999, [])]
    ink = lambda v: v > 0.55
    df = spark.createDataFrame(rasters, "i int, v array<double>").select("i", glyphs.features(F.col("v"), 8, ink).alias("f"), glyphs.components(glyphs.runs(F.col("v"), 8, ink)).alias("c"))
    got, seen = {r.i: r for r in df.collect()}, Counter()
    assert got[999].c == [] and got[999].f.holes == 0
    for i, v in rasters[:-1]:
        a = np.array(v).reshape(-1, 8) > 0.55
        label, half = pixels.labels(a), a.shape[0] // 2
        at = [np.nonzero(label == n) for n in np.unique(label[label > 0])]
        assert sorted(map(tuple, got[i].c)) == sorted((x.min(), y.min(), np.ptp(x) + 1, np.ptp(y) + 1, len(x)) for y, x in at)
        assert got[i].f.holes == pixels.hole_count(a, 3) and abs(got[i].f.upper - a[:half].mean()) < 1e-9 and abs(got[i].f.lower - a[half:].mean()) < 1e-9
        seen[got[i].f.holes] += 1
    assert len(seen) > 1
